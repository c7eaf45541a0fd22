"""Corpora for the queries, derived alike in Spark and in SQL from the provided tables."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cueforge.functions import text as X
from cueforge.operators.segments import even_spacing, intervals


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as segments; sixteen characters last a second."""
    c = table(spark, sf_dir, "conversations")
    order = Window.partitionBy("conv_id").orderBy("turn")
    upto = F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    before = F.coalesce(F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return c.select(F.col("conv_id").alias("video_id"), F.col("turn").alias("idx"), (before / F.lit(16.0)).alias("start"), (upto / F.lit(16.0)).alias("end"), "text")


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as segments of ten seconds."""
    d = table(spark, sf_dir, "documents")
    lines = d.select(F.col("doc_id").alias("video_id"), F.posexplode(X.splitlines(F.col("text"))).alias("idx", "text"))
    return lines.select("video_id", F.col("idx").cast("long").alias("idx"), (F.col("idx") * 10.0).alias("start"), (F.col("idx") * 10.0 + 10.0).alias("end"), "text")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of users as frames, by time; the duration is their span."""
    e = table(spark, sf_dir, "events")
    by_user = Window.partitionBy("user_id")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    span = (F.max(us).over(by_user) - F.min(us).over(by_user)) / F.lit(1e6)
    number = F.row_number().over(by_user.orderBy("ts", "event_id"))
    return e.select(F.col("user_id").alias("video_id"), F.format_string("frame_%06d.jpg", number).alias("file"), span.alias("duration"), "event_type")


def pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames as visual cues; a month of them lasts some three minutes."""
    lasting = intervals(even_spacing(frames(spark, sf_dir)), 2.0)
    text = F.concat(F.lit("picture "), (F.col("idx") % 3).cast("string"))
    return lasting.select("video_id", F.col("idx").cast("long").alias("idx"), (F.col("start") / 16384.0).alias("start"), (F.col("end") / 16384.0).alias("end"), text.alias("text"))


def qa_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as question-and-answer text, by line."""
    c = table(spark, sf_dir, "conversations")
    text = F.when(F.col("role") == "user", F.concat(F.lit("Q: "), "text")).when(F.col("role") == "assistant", F.concat(F.lit("A: "), "text")).otherwise(F.col("text"))
    lines = c.select(F.col("conv_id").alias("video_id"), "turn", F.posexplode(X.splitlines(text)).alias("at", "line"))
    return lines.select("video_id", (F.col("turn") * 1_000_000 + F.col("at")).alias("n"), "line")


def hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as hosts: memory, graphics memory and chip."""
    p = table(spark, sf_dir, "part")
    vram = F.when(F.col("p_partkey") % 5 == 0, (F.col("p_partkey") % 17).cast("double"))
    return p.select(F.col("p_partkey").alias("host"), F.col("p_size").cast("double").alias("ram"), vram.alias("vram"), (F.col("p_partkey") % 3 == 0).alias("apple"))


def markdown_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents made headings, list items, empty lines and paragraphs in turn."""
    rows = document_lines(spark, sf_dir)
    k = F.col("idx") % 5
    line = F.when(k == 0, F.concat(F.lit("# "), "text")).when(k.isin(1, 2), F.concat(F.lit("- "), "text")).when(k == 3, "").otherwise(F.col("text"))
    return rows.select("video_id", F.col("idx").alias("n"), line.alias("line"))


SEGMENTS = """segs AS (SELECT conv_id AS video_id, turn AS idx, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE / 16 AS "start",
 sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::DOUBLE / 16 AS "end", text FROM conversations)"""
_LINES = "string_split_regex({x}, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]')"


def sql_lines(x: str) -> str:
    """str.splitlines() in SQL."""
    parts = _LINES.format(x=x)
    return f"(CASE WHEN {parts}[-1] = '' THEN {parts}[:-2] ELSE {parts} END)"


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^[\\s\\p{{Z}}\\x0b\\x1c-\\x1f\\x{{85}}]+|[\\s\\p{{Z}}\\x0b\\x1c-\\x1f\\x{{85}}]+$', '', 'g')"


def sql_timecode(x: str, separator: str = ",") -> str:
    ms = f"round_even({x} * 1000, 0)::BIGINT"
    return f"printf('%02d:%02d:%02d{separator}%03d', {ms} // 3600000, {ms} // 60000 % 60, {ms} // 1000 % 60, {ms} % 1000)"


def sql_mmss(x: str) -> str:
    return f"printf('%02d:%02d', floor({x})::BIGINT // 60, floor({x})::BIGINT % 60)"


def sql_escape(x: str) -> str:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
        x = f"replace({x}, '{raw}', '{entity}')"
    return x


DOCUMENT_LINES = f"""dlines AS (SELECT doc_id AS video_id, unnest({sql_lines('text')}) AS text, generate_subscripts({sql_lines('text')}, 1) - 1 AS idx FROM documents)"""
FRAMES = """fr AS (SELECT user_id AS video_id, (max(epoch_us(ts)) OVER (PARTITION BY user_id) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1e6 AS duration, count(*) OVER (PARTITION BY user_id) AS n,
 row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx FROM events), raw AS (SELECT *, idx * (duration / n) AS x FROM fr),
 split AS (SELECT *, x * 134217729.0e0 - (x * 134217729.0e0 - x) AS h FROM raw), err AS (SELECT * EXCLUDE (h), x * 1000e0 AS p, (h * 1000e0 - x * 1000e0) + (x - h) * 1000e0 AS e FROM split),
 spaced AS (SELECT * EXCLUDE (x, p, e), CASE WHEN p - floor(p) = 0.5 AND e <> 0 THEN floor(p) + (e > 0)::INT ELSE round_even(p, 0) END / 1000e0 AS t FROM err)"""
PICTURES = FRAMES + """, pics AS (SELECT video_id, idx::BIGINT AS idx, t / 16384e0 AS "start", coalesce(lead(t) OVER (PARTITION BY video_id ORDER BY idx), t + 2.0e0) / 16384e0 AS "end", 'picture ' || (idx % 3)::VARCHAR AS text FROM spaced)"""
QA_TEXT = "qa AS (SELECT conv_id AS video_id, turn, CASE role WHEN 'user' THEN 'Q: ' || text WHEN 'assistant' THEN 'A: ' || text ELSE text END AS t FROM conversations)"
QA_LINES = f"""{QA_TEXT}, ql AS (SELECT video_id, turn * 1000000 + generate_subscripts({sql_lines('t')}, 1) - 1 AS n, unnest({sql_lines('t')}) AS line FROM qa)"""
HOSTS = "hosts AS (SELECT p_partkey AS host, p_size::DOUBLE AS ram, CASE WHEN p_partkey % 5 = 0 THEN (p_partkey % 17)::DOUBLE END AS vram, p_partkey % 3 = 0 AS apple FROM part)"
MARKDOWN = f"""{DOCUMENT_LINES}, md AS (SELECT video_id, idx AS n, CASE idx % 5 WHEN 0 THEN '# ' || text WHEN 3 THEN '' WHEN 4 THEN text ELSE '- ' || text END AS line FROM dlines)"""
