"""The queries op1 to op13 over whole tables, with production parameters."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversations, cws, hard_negatives, mixing, packing, posting_lists, quality, rules, sharding, simhash, substring, token_counts, toxicity

#: Margins of the mix: present shares to these powers; and the share of tokens that stays.
TEMPERATURES = {"source": 0.7, "lang": 0.8, "topic": 0.9}
KEEP = 0.8


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = substring.remove_repeats(_table(spark, sf_dir, "documents"), window=50, start=25)
    return rows.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.calibrate(_table(spark, sf_dir, "documents"), TEMPERATURES, KEEP, carry=["doc_id"])
    return rows.select("row.doc_id", "topic", F.col("tokens").alias("n_tokens"), F.round("probability", 6).alias("probability"), "kept")


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(_table(spark, sf_dir, "documents"), words=3, hashes=1, max_bits=2, similarity=None)
    return rows.select("doc_id", F.lpad(F.lower(F.hex(F.col("fp")[0])), 16, "0").alias("fingerprint"), "component_id")


def op2_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posting_lists.search(_table(spark, sf_dir, "embeddings"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"), shards=24)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), *token_counts.vocabulary(tokenizer_file("piece_bpe_32k.model")))


def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cws.fingerprint_documents(_table(spark, sf_dir, "documents"), samples=64)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), capacity=2048)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.audited(_table(spark, sf_dir, "conversations"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(hard_negatives.relabelled(_table(spark, sf_dir, "embeddings")))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_substring_dedup,
        op2_posting_lists,
        op3_quality_classifier,
        op4_sharding,
        op5_toxicity,
        op6_token_counts,
        op7_document_fingerprints,
        op8_mixing,
        op9_simhash_near_dedup,
        op10_best_fit_packing,
        op11_conversation_repair,
        op12_hard_negatives,
        op13_quality_rules,
    )
}
ORACLE_SQL: dict[str, str] = {"op8_mixing": mixing.oracle_sql(TEMPERATURES, KEEP), "op12_hard_negatives": hard_negatives.ORACLE_SQL}
