"""Texts of subtitle files and card files, and their writers."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueforge.functions import text as X
from cueforge.operators.segments import joined, numbered


def _every(documents: DataFrame, videos: DataFrame | None, empty: str) -> DataFrame:
    """documents, and for those of `videos` that have none an empty one."""
    if videos is None:
        return documents
    return videos.select("video_id").join(documents, "video_id", "left").withColumn("document", F.coalesce("document", F.lit(empty)))


def srt(segments: DataFrame, videos: DataFrame | None = None) -> DataFrame:
    """(video_id, document) in SRT; videos(video_id): also of those without segments."""
    cue = F.concat(F.col("number").cast("string"), F.lit("\n"), X.timecode(F.col("start")), F.lit(" --> "), X.timecode(F.col("end")), F.lit("\n"), X.strip(F.col("text")), F.lit("\n"))
    return _every(joined(numbered(segments).withColumn("cue", cue), "video_id", "number", "cue", "\n", "document"), videos, "")


def vtt(segments: DataFrame, videos: DataFrame | None = None) -> DataFrame:
    """(video_id, document) in WebVTT; videos(video_id): also of those without segments."""
    cue = F.concat(X.timecode(F.col("start"), "."), F.lit(" --> "), X.timecode(F.col("end"), "."), F.lit("\n"), X.strip(F.col("text")), F.lit("\n"))
    out = joined(numbered(segments).withColumn("cue", cue), "video_id", "number", "cue", "\n", "body")
    return _every(out.select("video_id", F.concat(F.lit("WEBVTT\n\n"), "body").alias("document")), videos, "WEBVTT\n\n")


def _listed(segments: DataFrame) -> DataFrame:
    """(video_id, segments): start, end and text of each segment, in order."""
    items = F.array_sort(F.collect_list(F.struct("idx", "start", "end", "text")))
    bare = F.transform(items, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text")))
    return segments.groupBy("video_id").agg(bare.alias("segments"))


def captions_json(segments: DataFrame, videos: DataFrame | None = None) -> DataFrame:
    """(video_id, document): the segments of a video as a JSON array; videos(video_id): also of those without segments."""
    return _every(_listed(segments).select("video_id", F.to_json("segments").alias("document")), videos, "[]")


def subtitles_json(segments: DataFrame, files: DataFrame) -> DataFrame:
    """(video_id, document): an object of language, language_probability and duration, as files(video_id, ...) has them, and segments. A row a file; a file without segments has none in it, an unknown language is null."""
    none = F.array().cast("array<struct<start:double,end:double,text:string>>")
    both = files.join(_listed(segments), "video_id", "left").withColumn("segments", F.coalesce("segments", none))
    return both.select("video_id", F.to_json(F.struct("language", "language_probability", "duration", "segments"), {"ignoreNullFields": "false"}).alias("document"))


def write_cards(cards: DataFrame, path: str) -> None:
    """Card files with header and CRLF, quoted as needed."""
    rows = cards.select("question", "answer", "tags", "timestamp", "source")
    rows.write.mode("overwrite").csv(path, header=True, escape='"', emptyValue="", lineSep="\r\n")


def cards_csv(cards: DataFrame, videos: DataFrame) -> DataFrame:
    """(video_id, document): a card file a video, with its header even where there is no card; fields are quoted as needed."""
    quoted = lambda c: F.when(F.col(c).rlike("[\",\r\n]"), F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.col(c))
    names = ("question", "answer", "tags", "timestamp", "source")
    line = F.concat(F.concat_ws(",", *map(quoted, names)), F.lit("\r\n"))
    rows = joined(cards.withColumn("line", line), "video_id", "ord", "line", "", "rows")
    return videos.select("video_id").join(rows, "video_id", "left").select("video_id", F.concat(F.lit(",".join(names) + "\r\n"), F.coalesce("rows", F.lit(""))).alias("document"))
