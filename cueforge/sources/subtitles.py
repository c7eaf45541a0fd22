"""Readers of subtitle files, frame manifests, cards and templates."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cueforge.functions import text as X
from cueforge.operators.metrics import RunMetrics, watched

# The segment type and the pattern of a cue's times.
SEGMENTS = "array<struct<start:double,end:double,text:string>>"
_TIMES = "^(\\d+):(\\d+):(\\d+)[,.](\\d+)\\s*-->\\s*(\\d+):(\\d+):(\\d+)[,.](\\d+)"

VTT_TIMES = "^[ \\t]*(?:(\\d{2,}):)?([0-5]\\d):([0-5]\\d)\\.(\\d{3})[ \\t]*-->[ \\t]*(?:(\\d{2,}):)?([0-5]\\d):([0-5]\\d)\\.(\\d{3})(?:[ \\t]+(.*))?$"
_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", "\u00a0"), ("&lrm;", "\u200e"), ("&rlm;", "\u200f"), ("&amp;", "&"))


def json_segments(document: Column) -> Column:
    """Segments of a JSON document: a bare array, or what its `segments` holds, or else its `captions`; null if it is no JSON."""
    v = F.try_parse_json(document)
    at = lambda path: F.coalesce(F.try_variant_get(v, path, SEGMENTS), F.array().cast(SEGMENTS))
    bare = F.try_variant_get(v, "$", SEGMENTS)
    return F.when(v.isNull(), F.lit(None).cast(SEGMENTS)).when(bare.isNotNull(), bare).when(F.size(at("$.segments")) > 0, at("$.segments")).otherwise(at("$.captions"))


def srt_segments(docs: DataFrame, metrics: RunMetrics | None = None) -> DataFrame:
    """docs(video_id, document) -> (video_id, idx, start, end, text), idx from 0 in the order of cues. A cue has three lines that are not blank; its second one starts with the times. metrics: counts cues_read and blocks_dropped."""
    blocks = docs.select("video_id", F.posexplode(F.split(X.strip(X.newlines(F.col("document"))), "\\n\\s*\\n")).alias("block", "cue"))
    lines = blocks.select("video_id", "block", F.filter(X.splitlines(F.col("cue")), lambda s: X.strip(s) != "").alias("lines"))
    valid = F.coalesce((F.size("lines") >= 3) & F.get("lines", F.lit(1)).rlike(_TIMES), F.lit(False))
    good = watched(metrics, lines, cues_read=valid, blocks_dropped=~valid & (F.size("lines") > 0)).filter(valid)
    g = [F.regexp_extract(F.get("lines", F.lit(1)), _TIMES, i).cast("double") for i in range(1, 9)]
    at = lambda i: g[i] * 3600 + g[i + 1] * 60 + g[i + 2] + g[i + 3] / 1000
    text = F.array_join(F.slice("lines", 3, 1_000_000_000), " ")
    return good.select("video_id", F.col("block").alias("idx"), at(0).alias("start"), at(4).alias("end"), text.alias("text"))


def vtt_segments(docs: DataFrame, plain: bool = False) -> DataFrame:
    """docs(video_id, document) in WebVTT -> (video_id, idx, start, end, text, settings), idx from 0 in the order of cues.

    A document starts with `WEBVTT`; what follows on that line, and lines up to the first blank one that hold no cue, are its
    header. Notes, styles and regions have no times and are no cues. A cue may have an identifier above its times, hours
    only where it needs them, and settings behind them. Its lines are joined by one space. plain: tags are taken out,
    and entities are the characters that they stand for. Other documents give nothing.
    """
    whole = X.newlines(F.regexp_replace(F.col("document"), "^\\ufeff", ""))
    own = docs.select("video_id", whole.alias("document")).filter(F.col("document").rlike("^WEBVTT([ \\t\\n]|\\z)"))
    body = F.regexp_replace("document", "^WEBVTT[^\\n]*", "")
    blocks = own.select("video_id", F.posexplode(F.split(body, "\\n{2,}")).alias("block", "cue"))
    lines = blocks.select("video_id", "block", F.split(F.regexp_replace("cue", "^\\n+|\\n+$", ""), "\n").alias("lines"))
    times = F.when(F.contains(F.get("lines", F.lit(0)), F.lit("-->")), F.lit(0)).otherwise(1)
    cues = lines.select("video_id", "block", "lines", times.alias("at")).filter(F.coalesce(F.get("lines", F.col("at")).rlike(VTT_TIMES), F.lit(False)))
    g = [F.coalesce(F.nullif(F.regexp_extract(F.get("lines", F.col("at")), VTT_TIMES, i), F.lit("")), F.lit("0")).cast("double") for i in range(1, 9)]
    seconds = lambda i: g[i] * 3600 + g[i + 1] * 60 + g[i + 2] + g[i + 3] / 1000
    text = F.array_join(F.slice("lines", F.col("at") + 2, F.lit(1_000_000_000)), " ")
    if plain:
        text = F.regexp_replace(text, "<[^>]*>", "")
        for entity, letter in _ENTITIES:
            text = F.replace(text, F.lit(entity), F.lit(letter))
    order = F.row_number().over(Window.partitionBy("video_id").orderBy("block")) - 1
    return cues.select("video_id", order.alias("idx"), seconds(0).alias("start"), seconds(4).alias("end"), text.alias("text"), F.regexp_extract(F.get("lines", F.col("at")), VTT_TIMES, 9).alias("settings"))


def read_subtitles(spark: SparkSession, path: str, vtt: bool = False, metrics: RunMetrics | None = None) -> DataFrame:
    """Files under path -> (video_id, idx, start, end, text); video_id is the file's name. Files not called .json are SRT; so the cues of VTT files, which have two lines, give nothing, unless vtt is set: then files called .vtt are WebVTT."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("video_id"), X.newlines(F.col("value")).alias("document"))
    is_json = F.lower("video_id").endswith(".json")
    parsed = files.filter(is_json).select("video_id", F.posexplode(json_segments(F.col("document"))).alias("idx", "s")).select("video_id", "idx", "s.start", "s.end", "s.text")
    is_vtt = F.lower("video_id").endswith(".vtt") if vtt else F.lit(False)
    out = parsed.unionByName(srt_segments(files.filter(~is_json & ~is_vtt), metrics))
    return out.unionByName(vtt_segments(files.filter(is_vtt)).drop("settings")) if vtt else out


def rejected_subtitles(spark: SparkSession, path: str) -> DataFrame:
    """JSON files under path that can't be parsed."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("video_id"), F.col("value").alias("document"))
    return files.filter(F.lower("video_id").endswith(".json") & F.try_parse_json("document").isNull())


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """Frame manifests -> (video, interval, idx, file, t)."""
    schema = "video string, interval double, fps double, count int, frames array<struct<file:string,t:double>>"
    docs = spark.read.schema(schema).json(path, multiLine=True)
    return docs.select("video", "interval", F.posexplode("frames").alias("idx", "f")).select("video", "interval", "idx", "f.file", "f.t")


def read_cards(spark: SparkSession, path: str) -> DataFrame:
    """Card files; a missing value is an empty string."""
    names = ("question", "answer", "tags", "timestamp", "source")
    rows = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', schema=", ".join(f"{n} string" for n in names))
    return rows.select(*[F.coalesce(n, F.lit("")).alias(n) for n in names])


def read_template(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()
