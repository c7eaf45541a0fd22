"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations alone.

Token weights are summed to cells (source, language, topic). A dimension's targets are the present shares to a power; as
documents are not doubled, a margin's target is at most what it has, and the excess goes to the dimension's other margins
in proportion. The cells are raked: in turn, each dimension's margins are scaled to their targets, where a cell that is
kept whole stays so and the others of its margin make up for it. What is left of a cell is its documents' probability; a
document stays if a hash of its doc_id is below it.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import discard, staged

DIMENSIONS = ("source", "lang", "topic")
#: Topics by what a text contains, the first that holds; else "prose".
TOPICS = {"contact": "[A-Za-z0-9]@[A-Za-z0-9]", "legal": "(?i)licen[cs]e|copyright", "figures": "[0-9]"}
_SMALL = 10_000  # cells up to which raking is one task and the table is broadcast; the numbers are the same either way
_BLOCK = 10  # rounds between two looks at the margins


def topic_of(text: Column, topics: dict[str, str]) -> Column:
    """A document's topic by rules. Null and empty texts are prose."""
    t, out = F.coalesce(text, F.lit("")), F
    for name, pattern in topics.items():
        out = out.when(t.rlike(pattern), name)
    return F.lit("prose") if out is F else out.otherwise("prose")


def token_weight(text: Column) -> Column:
    """Words of a text; 0 for null and empty ones."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def targets(cells: DataFrame, dimension: str, temperature: float, keep: float, total: int) -> DataFrame:
    """cells(dimensions, tokens) -> (dimension, target): tokens that each margin is to keep, of keep * total. One row a margin."""
    p = F.col("tokens") / F.lit(float(total))
    shares = cells.groupBy(dimension).agg(F.sum("tokens").cast("double").alias("tokens")).withColumn("q", F.pow(p, F.lit(float(temperature)))).withColumn("cap", p / F.lit(float(keep)))
    line = Window.orderBy(F.col("cap") / F.col("q"), dimension)
    before, after = line.rowsBetween(Window.unboundedPreceding, -1), line.rowsBetween(0, Window.unboundedFollowing)
    # the scale if this margin is the first, by cap / q, that does not reach its cap: it rises up to the right one and falls after
    scaled = shares.withColumn("scale", (F.lit(1.0) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("q").over(after))
    common = scaled.withColumn("common", F.max("scale").over(Window.partitionBy()))
    return common.select(dimension, (F.least(F.col("cap"), F.col("common") * F.col("q")) * F.lit(float(keep) * total)).alias("target"))


def step(cells: DataFrame, dimension: str) -> DataFrame:
    """One scaling of `weight` to the margins of a dimension, tokens at most."""
    margin, target = Window.partitionBy(dimension), F.col(f"to_{dimension}")
    cells = cells.withColumns({"sum": F.sum("weight").over(margin), "free": F.sum(F.when(F.col("weight") < F.col("tokens"), F.col("weight")).otherwise(0.0)).over(margin)})
    up = F.least(F.col("tokens").cast("double"), F.col("weight") * (target - (F.col("sum") - F.col("free"))) / F.col("free"))
    new = F.when(F.col("sum") >= target, F.col("weight") * target / F.col("sum")).when((F.col("weight") < F.col("tokens")) & (F.col("free") > 0), up).otherwise(F.col("weight"))
    return cells.withColumn("weight", new).drop("sum", "free")


def gap(cells: DataFrame, dimensions) -> float:
    """The greatest difference of a margin's weight from its target, as a part of the total."""
    total = F.sum("weight")
    parts = [cells.groupBy(F.lit(d).alias("dimension"), F.col(d).alias("value")).agg((F.sum("weight") - F.first(f"to_{d}")).alias("off"), total.alias("weight")) for d in dimensions]
    for p in parts[1:]:
        parts[0] = parts[0].union(p)
    sums = parts[0].groupBy("dimension").agg(F.max(F.abs("off")).alias("off"), F.sum("weight").alias("weight"))
    return sums.agg(F.max(F.col("off") / F.col("weight"))).first()[0] or 0.0


def rake(cells: DataFrame, temperatures: dict[str, float], keep: float, tolerance: float = 1e-3, blocks: int = 10) -> DataFrame:
    """cells(dimensions, tokens) -> the same with `weight`, the tokens to keep of each, and `to_...`, the margins' targets.

    Margins are the present ones to the power of the dimension's temperature (1 leaves them, 0 makes them equal), as far as
    there are tokens for them, of keep times the total. Rounds go on, in blocks of 10, until every margin is within
    `tolerance` of the total of its target or `blocks` are done (margins of different dimensions may contradict).
    """
    total = cells.agg(F.sum("tokens")).first()[0] or 1
    small = cells.count() <= _SMALL
    out = cells.withColumn("weight", F.col("tokens") * F.lit(float(keep)))
    for d, t in temperatures.items():
        out = out.join(targets(cells, d, t, keep, total).withColumnRenamed("target", f"to_{d}"), d)
    out = staged(out.coalesce(1) if small else out, "raked")
    for _ in range(blocks):
        after = out.coalesce(1) if small else out  # one task needs no exchange between its steps
        for _ in range(_BLOCK):
            for d in temperatures:
                after = step(after, d)
        after = staged(after, "raked")
        discard(out)
        out = after
        if gap(out, temperatures) <= tolerance:
            break
    return out.select(*DIMENSIONS, "tokens", "weight", *[f"to_{d}" for d in temperatures])


def chance(doc_id: Column) -> Column:
    """A number in [0, 1) that only the doc_id decides; a null one has the chance of the empty string."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def calibrate(docs: DataFrame, temperatures: dict[str, float], keep: float, carry: list[str] | None = None, topics: dict[str, str] = TOPICS) -> DataFrame:
    """docs(doc_id, text, lang, source, ...) -> (row, source, lang, topic, tokens, probability, kept): `row` a struct of docs' columns, or of those in `carry`.

    A document's probability is that of its cell: the part of its tokens that raking keeps. Documents without words weigh
    nothing and have `keep`. Null languages and sources are categories of their own, "" (others are "=..."). Rows with one
    doc_id share their draw. An empty table gives an empty one. Columns of docs with the names of results stay within
    `row`. Texts are read once, and what is carried is written once; cells are summed before anything is shuffled, so one
    source with most rows is one row a task.
    """
    category = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit(""))
    rows = docs.select(F.struct(*(carry or docs.columns)).alias("row"), chance(F.col("doc_id")).alias("lot"), category("source").alias("source"), category("lang").alias("lang"), topic_of(F.col("text"), topics).alias("topic"), token_weight(F.col("text")).alias("tokens"))
    rows = staged(rows, "rows")
    cells = staged(rows.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")).filter("tokens > 0"), "cells")
    small = cells.count() <= _SMALL
    raked = rake(cells, temperatures, keep).select(*DIMENSIONS, (F.col("weight") / F.col("tokens")).alias("part"))
    joined = rows.join(F.broadcast(raked) if small else raked, list(DIMENSIONS), "left").withColumn("probability", F.coalesce("part", F.lit(float(keep))))
    return joined.select("row", *DIMENSIONS, "tokens", "probability", (F.col("lot") < F.col("probability")).alias("kept"))


def oracle_sql(temperatures: dict[str, float], keep: float) -> str:
    """DuckDB SQL for calibrate() over `documents`, with each raking step of one block a common table."""
    cases = " ".join(f"WHEN regexp_matches(coalesce(text, ''), '{p}') THEN '{n}'" for n, p in TOPICS.items())
    steps = [f"""docs AS MATERIALIZED (SELECT doc_id, coalesce('=' || source, '') AS source, coalesce('=' || lang, '') AS lang, CASE {cases} ELSE 'prose' END AS topic,
 len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS tokens FROM documents)""",
        "cells AS MATERIALIZED (SELECT source, lang, topic, sum(tokens)::BIGINT AS tokens FROM docs GROUP BY ALL HAVING sum(tokens) > 0)",
        "total AS MATERIALIZED (SELECT sum(tokens)::DOUBLE AS n FROM cells)"]
    for d, t in temperatures.items():
        steps.append(f"p_{d} AS MATERIALIZED (SELECT {d}, pow(sum(tokens)::DOUBLE / (SELECT n FROM total), {float(t)}) AS q, sum(tokens)::DOUBLE / (SELECT n FROM total) / {float(keep)} AS cap FROM cells GROUP BY {d})")
        steps.append(f"c_{d} AS MATERIALIZED (SELECT *, (1 - coalesce(sum(cap) OVER (ORDER BY cap / q, {d} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(q) OVER (ORDER BY cap / q, {d} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS scale FROM p_{d})")
        steps.append(f"m_{d} AS MATERIALIZED (SELECT {d}, least(cap, q * (SELECT max(scale) FROM c_{d})) * {float(keep)} * (SELECT n FROM total) AS target FROM c_{d})")
    steps.append(f"r0 AS MATERIALIZED (SELECT *, tokens * {float(keep)}::DOUBLE AS weight FROM cells)")
    n = 0
    for _ in range(_BLOCK):
        for d in temperatures:
            sums = f"SELECT r.*, target, sum(weight) OVER w AS s, sum(CASE WHEN weight < tokens THEN weight ELSE 0 END) OVER w AS f FROM r{n} r JOIN m_{d} USING ({d}) WINDOW w AS (PARTITION BY {d})"
            steps.append(f"r{n + 1} AS MATERIALIZED (SELECT source, lang, topic, tokens, CASE WHEN s >= target THEN weight * target / s WHEN weight < tokens AND f > 0 THEN least(tokens::DOUBLE, weight * (target - (s - f)) / f) ELSE weight END AS weight FROM ({sums}))")
            n += 1
    return "WITH " + ",\n".join(steps) + f"""
SELECT doc_id, d.topic AS topic, d.tokens AS n_tokens, round(coalesce(weight / r.tokens, {keep}), 6) AS probability,
 ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0 < coalesce(weight / r.tokens, {keep}) AS kept
FROM docs d LEFT JOIN r{n} r ON d.source = r.source AND d.lang = r.lang AND d.topic = r.topic"""
