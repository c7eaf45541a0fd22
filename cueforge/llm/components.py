"""Connected components of a link table, by alternating large-star and small-star joins."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, staged


def _towards_least(pairs: DataFrame, only_larger: bool) -> DataFrame:
    """(node, other) -> other's link to the least of node's neighbours and itself. The least is a partial aggregate, so that a node with many links stays divisible."""
    least = pairs.groupBy("a").agg(F.min("b").alias("m"))
    if only_larger:
        least = least.select("a", F.least("a", "m").alias("m"))
    joined = pairs.join(least, "a")
    if only_larger:
        return joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """edges(a long, b long) -> (node long, root long), root the least node of the component.

    Direction, repeats and self-links do not matter; rows with a null are dropped. Nodes without a link have no row.
    Every round is written to the shared folder; nothing is collected but a count and a checksum.
    """
    spark = edges.sparkSession
    now = staged(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a is not null and b is not null and a <> b").distinct(), "links")
    seen = None
    for _ in range(rounds):
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if not mark[0]:
            return spark.createDataFrame([], "node long, root long")
        if mark == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b"), F.col("b")).distinct())
        seen = mark
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _towards_least(both, True).filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        small = _towards_least(large, False).filter("a <> b").distinct()
        after = staged(small, "links")
        discard(now)
        now = after
    raise RuntimeError(f"components did not settle in {rounds} rounds")
