"""Spoken and visual cues of the same video, joined where their times overlap."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cueforge.operators.segments import joined

#: What joins a spoken text to what is seen meanwhile, and captions to each other.
SEEN, BETWEEN = " 〔", "；"
#: A bucket is split where one side has more rows than this and than a share of all rows; so at most HOT buckets of a side are.
_LONG, HOT = 2000, 100_000
#: A cue touches about so many buckets of its own level; each level's are so many times as wide as those of the one below.
_STEP = 64


def _levelled(cues: DataFrame, width: float) -> DataFrame:
    """cues that have finite times, with the least level at which they touch _STEP buckets or so; all others overlap nothing."""
    finite = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < 1e15) for c in ("start", "end")]
    steps = F.log((F.col("end") - F.col("start")) / (width * _STEP)) / F.log(F.lit(float(_STEP)))
    level = F.when(F.col("end") - F.col("start") > width * _STEP, F.ceil(steps)).otherwise(0)
    return cues.filter(finite[0] & finite[1] & F.col("video_id").isNotNull()).withColumn("level", level.cast("int"))


def _bucketed(cues: DataFrame, width: float, levels: list[int], prefix: str) -> DataFrame:
    """A row for each bucket that a cue touches, at its own level and at all above on which there is a cue."""
    at = F.explode(F.filter(F.array(*map(F.lit, levels)), lambda x: x >= F.col("level")))
    rows = cues.select("*", at.alias("at"))
    wide = F.lit(width) * F.pow(F.lit(float(_STEP)), F.col("at"))
    first, last = (F.floor(x / wide).cast("long") for x in (F.col("start"), F.greatest("start", "end")))
    named = [F.col(c).alias(f"{prefix}_{c}") for c in ("idx", "start", "end", "text", "level")]
    return rows.select("video_id", "at", F.explode(F.sequence(first, last)).alias("bucket"), *named)


def _crowded(spoken: DataFrame, visual: DataFrame, long: int) -> DataFrame:
    """(video_id, at, bucket, spoken_parts, visual_parts) of buckets that are split. long is raised to a HOTth of all rows, which bounds their number."""
    keys = ["video_id", "at", "bucket"]
    sides = spoken.select(*keys, F.lit(1).alias("a"), F.lit(0).alias("b")).union(visual.select(*keys, F.lit(0).alias("a"), F.lit(1).alias("b")))
    counts = sides.groupBy(*keys).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    total = counts.agg(F.coalesce(F.sum(F.col("a") + F.col("b")), F.lit(0))).first()[0]
    limit = max(long, -(-total // HOT))
    crowded = counts.filter((F.col("a") > limit) | (F.col("b") > limit))
    return crowded.select(*keys, *[F.ceil(F.greatest(F.col(c), F.lit(1)) / limit).cast("int").alias(n) for c, n in (("a", "spoken_parts"), ("b", "visual_parts"))])


def overlapping(spoken: DataFrame, visual: DataFrame, width: float = 10.0, long: int = _LONG) -> DataFrame:
    """spoken and visual (video_id, idx, start, end, text) -> (video_id, spoken_idx, spoken_start, spoken_end, spoken_text, visual_idx, ...), each pair with spoken.start < visual.end and visual.start < spoken.end once.

    An equi-join on (video, level, bucket of time). Buckets of level 0 are `width` seconds wide; long cues have levels of
    wider buckets, so that none touches very many. A pair is told at the higher level of its two cues, in the bucket in
    which the later of them begins. A bucket of over `long` cues is a grid: each side is dealt into parts by idx, and a row
    meets every part of the other side.
    """
    one_side, other_side = _levelled(spoken, width), _levelled(visual, width)
    levels = sorted(r.level for r in one_side.select("level").union(other_side.select("level")).distinct().collect()) or [0]  # eight at most
    a, b = _bucketed(one_side, width, levels, "spoken"), _bucketed(other_side, width, levels, "visual")
    crowded = F.broadcast(_crowded(a, b, long))  # 2 HOT rows at most
    one = F.coalesce("spoken_parts", F.lit(1)), F.coalesce("visual_parts", F.lit(1))
    keys = ["video_id", "at", "bucket"]

    def dealt(rows: DataFrame, idx: str, own: int) -> DataFrame:
        part = F.pmod(F.xxhash64(idx), one[own]).cast("int")
        others = F.explode(F.sequence(F.lit(0), one[1 - own] - 1))
        kept = [c for c in rows.columns if c not in keys]
        return rows.join(crowded, keys, "left").select(*keys, part.alias(f"part{own}"), others.alias(f"part{1 - own}"), *kept)

    pairs = dealt(a, "spoken_idx", 0).join(dealt(b, "visual_idx", 1), [*keys, "part0", "part1"])
    meets = (F.col("spoken_start") < F.col("visual_end")) & (F.col("visual_start") < F.col("spoken_end"))
    wide = F.lit(width) * F.pow(F.lit(float(_STEP)), F.col("at"))
    told = (F.col("at") == F.greatest("spoken_level", "visual_level")) & (F.floor(F.greatest("spoken_start", "visual_start") / wide) == F.col("bucket"))
    return pairs.filter(meets & told).drop("at", "bucket", "part0", "part1", "spoken_level", "visual_level")


def both_paths(spoken: DataFrame, visual: DataFrame, width: float = 10.0) -> DataFrame:
    """Segments of both paths: each spoken cue, followed in brackets by the captions of what is seen meanwhile, in order and each once; visual cues during which nothing is said are segments of their own. idx is new, by start, end and path."""
    pairs = overlapping(spoken, visual, width)
    seen = pairs.groupBy("video_id", "spoken_idx", "visual_text").agg(F.min("visual_idx").alias("at"))
    keyed = seen.select(F.struct("video_id", "spoken_idx").alias("cue"), "at", "visual_text")
    texts = joined(keyed, "cue", "at", "visual_text", BETWEEN, "seen").select("cue.video_id", F.col("cue.spoken_idx").alias("idx"), "seen")
    told = spoken.join(texts, ["video_id", "idx"], "left").select("video_id", "idx", "start", "end", F.concat("text", F.coalesce(F.concat(F.lit(SEEN), "seen", F.lit("〕")), F.lit(""))).alias("text"), F.lit(0).alias("path"))
    heard = pairs.select("video_id", F.col("visual_idx").alias("idx")).distinct()
    silent = visual.join(heard, ["video_id", "idx"], "left_anti").select("video_id", "idx", "start", "end", "text", F.lit(1).alias("path"))
    return _renumbered(told.unionByName(silent))


def _renumbered(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("video_id").orderBy("start", "end", "path", "idx")
    return rows.withColumn("idx", F.row_number().over(order) - 1).select("video_id", F.col("idx").cast("long").alias("idx"), "start", "end", "text")
