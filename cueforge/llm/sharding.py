"""Sharding by balanced label propagation over links of equal text.

Documents start in shards dealt by hash. Each round tallies, by joins, how many members of a link every shard has, and
moves members to the shard of most; where more want in than a shard's quota allows, a hashed share of links is admitted.
Rounds end when no member is apart from most of its link, or a round brings none nearer.
Groups too large for a shard are first parted into links of a tenth of a shard. At the end unlinked documents (and what
stands over a shard's capacity) fill all shards to counts that differ by one at most.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import discard, staged

_PART = 10  # links a shard holds of a group that is too large for one


def ranked(df: DataFrame, by: list[str], bucket: Column, order: list[str], parts: int) -> DataFrame:
    """df with rank (0, 1, ... within `by`, by bucket and then `order`). Only the sizes of `parts` buckets are summed in one place, so a large group is spread over tasks."""
    df = df.withColumn("_bucket", F.pmod(bucket, F.lit(parts)))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = df.groupBy(*by, "_bucket").agg(F.count("*").alias("_n")).select(*by, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = Window.partitionBy(*by, "_bucket").orderBy(*order)
    return df.join(sizes, [*by, "_bucket"]).withColumn("rank", F.col("_before") + F.row_number().over(own) - 1).drop("_bucket", "_before")


def _by_shard(values: list, kind: str) -> Column:
    return F.array(*[F.lit(v).cast(kind) for v in values])


def _loads(df: DataFrame, column: str, shards: int, value: Column | None = None) -> list[int]:
    """A number for each shard; `shards` rows reach the driver."""
    got = dict(df.groupBy(column).agg((F.count("*") if value is None else F.sum(value)).alias("n")).collect())
    return [int(got.get(s, 0)) for s in range(shards)]


def apart(linked: DataFrame) -> int:
    """The cut: members of linked(link, shard) that are not in the shard of most of their link."""
    tally = linked.groupBy("link", "shard").agg(F.count("*").alias("n"))
    return tally.groupBy("link").agg((F.sum("n") - F.max("n")).alias("n")).agg(F.sum("n")).first()[0] or 0


def propagate(linked: DataFrame, caps: list[int], rounds: int) -> DataFrame:
    """linked(link, shard, ...) -> the same rows with shards moved towards those of most of their link, until no member is apart, a round brings none together, or `rounds` are done."""
    shards, before = len(caps), None
    for turn in range(rounds):
        tally = linked.groupBy("link", "shard").agg(F.count("*").alias("n"))
        best = tally.groupBy("link").agg(F.max(F.struct("n", F.xxhash64("link", "shard").alias("tie"), "shard"))["shard"].alias("to"))
        moves = tally.join(best, "link").filter("shard <> to")
        flows = moves.groupBy("shard", "to").agg(F.sum("n").alias("n")).collect()  # shards x shards at most
        now = sum(n for *_, n in flows)
        if not now or now == before:
            break
        before = now
        load, wanted, leaving = _loads(linked, "shard", shards), [0] * shards, [0] * shards
        for a, b, n in flows:
            wanted[b] += n
            leaving[a] += n
        share = [min(1.0, max(0, caps[s] - load[s] + leaving[s]) / wanted[s]) if wanted[s] else 1.0 for s in range(shards)]
        lot = F.pmod(F.xxhash64("link", F.lit(turn)), F.lit(1 << 20)) / F.lit(float(1 << 20))
        admitted = staged(best.filter(lot < _by_shard(share, "double")[F.col("to")]), "admitted")
        after = staged(linked.join(admitted, "link", "left").withColumn("shard", F.coalesce("to", "shard")).drop("to"), "labels")
        discard(linked, admitted)
        linked = after
    return linked


def shard_documents(docs: DataFrame, shards: int = 24, rounds: int = 12) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, size, text_crc32, law, shard, slot, grown_shard), one row a row of docs.

    Law `rows`: shards' counts are at most one apart. Links: equal texts, two nulls included. size: UTF-8 bytes (null: 0)
    plus 8; text_crc32 of a null text is that of the empty one, 0. Slots are 0, 1, ... within a shard. Null and repeated
    doc_ids and repeated rows are documents like any other; other columns are ignored; an empty table gives an empty one.
    """
    key = F.xxhash64(F.col("text").isNull(), F.length("text"), F.md5("text"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"), F.coalesce(F.crc32("text"), F.lit(0)).cast("long").alias("text_crc32"), key.alias("key"))
    rows = staged(rows, "rows")
    total = rows.count()
    caps = [total // shards + (s < total % shards) for s in range(shards)]
    most = max(1, caps[-1] // _PART)
    parts = max(512, total // 100_000)
    # both sides of the joins on a text's key are tables, so a text of very many rows is split by the engine's skew join
    counts = staged(rows.groupBy("key").agg(F.count("*").alias("n")), "counts")
    chunk = F.pmod(F.xxhash64("doc_id"), F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(most)).cast("long")))
    first = F.when(F.col("n") <= most, F.pmod(F.xxhash64("doc_id", "key"), F.lit(shards))).otherwise(F.pmod(F.col("key") + F.floor(F.col("chunk") / _PART), F.lit(shards)))
    rows_n = rows.join(counts, "key").withColumn("chunk", chunk)
    rows_n = rows_n.withColumn("link", F.when(F.col("n") <= most, F.col("key")).otherwise(F.xxhash64("key", "chunk"))).withColumn("shard", F.when(F.col("n") > 1, first).cast("int"))
    placed = staged(rows_n.withColumn("place", F.col("key") + F.col("chunk")).select("doc_id", "size", "text_crc32", "link", "place", "shard"), "rows")
    discard(rows, counts)
    linked = propagate(staged(placed.filter("shard is not null"), "labels"), caps, rounds)
    loose = placed.filter("shard is null")
    load = _loads(linked, "shard", shards)
    if any(n > c for n, c in zip(load, caps, strict=True)):
        over = staged(ranked(linked, ["shard"], F.col("place"), ["place", "link", "doc_id", "text_crc32"], parts).withColumn("over", F.col("rank") >= _by_shard(caps, "long")[F.col("shard")]).drop("rank"), "over")
        linked = over.filter("not over").drop("over")
        loose = loose.unionByName(over.filter("over").drop("over"))
        load = [min(n, c) for n, c in zip(load, caps, strict=True)]
    ends, at = [], 0
    for n, c in zip(load, caps, strict=True):
        at += c - n
        ends.append(at)
    filled = ranked(loose.withColumn("all", F.lit(0)), ["all"], F.col("place"), ["place", "link", "doc_id", "text_crc32", "size"], parts).drop("all")
    filled = filled.withColumn("shard", F.size(F.filter(_by_shard(ends, "long"), lambda e: e <= F.col("rank"))).cast("int")).drop("rank")
    dealt = staged(linked.unionByName(filled.select(*linked.columns)), "dealt")
    out = ranked(dealt, ["shard"], F.xxhash64("doc_id", "link"), ["doc_id", "link", "text_crc32", "size"], max(64, parts // shards))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("rank").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
