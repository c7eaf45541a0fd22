"""Hardware profiles: the rule cascade and the table it looks up."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The profile table (profile, speech model, compute type, device, vision model, note) and the heavy models.
PROFILES = [
    ("tiny", "tiny", "int8", "cpu", "moondream", "极低配/老设备，仅保证能跑"),
    ("low", "base", "int8", "cpu", "openbmb/minicpm-v4.6:latest", "6-8GB 无独立GPU"),
    ("low-mac", "small", "int8", "cpu", "openbmb/minicpm-v4.6:latest", "Apple Silicon 6-8GB（Metal 加速抽帧）"),
    ("mid", "small", "int8", "cpu", "openbmb/minicpm-v4.6:latest", "8-16GB 通用"),
    ("high", "medium", "int8_float16", "auto", "qwen2.5vl:3b", "16-32GB，可上 medium"),
    ("high-gpu", "large-v3", "float16", "cuda", "qwen2.5vl:7b", "NVIDIA >=8GB VRAM，CUDA 全速"),
    ("max", "large-v3", "float16", "auto", "qwen2.5vl:7b", "工作站/服务器 >32GB"),
]
HEAVY = ("large", "large-v1", "large-v2", "large-v3", "medium")


def select_profile(ram: Column, vram: Column, apple: Column) -> Column:
    """ram, vram in GB; apple: whether there is such a chip. The first rule that holds."""
    return (
        F.when(vram >= 8, "high-gpu")
        .when(ram >= 32, "max")
        .when(ram >= 16, "high")
        .when(apple & (ram >= 6) & (ram < 8), "low-mac")
        .when(ram >= 8, "mid")
        .when(ram >= 6, "low")
        .otherwise("tiny")
    )


def table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PROFILES, "profile string, asr string, compute string, device string, vlm string, note string")


def look_up(hosts: DataFrame) -> DataFrame:
    """hosts(profile, ...) with its profile's values; the table has seven rows."""
    return hosts.join(F.broadcast(table(hosts.sparkSession)), "profile")


def heavy_warning(model: Column, ram: Column, profile: Column) -> Column:
    """A heavy model where memory is known and under 16 GB, unless a graphics card does the work."""
    return F.coalesce(model.isin(*HEAVY) & (ram != 0) & (ram < 16) & (profile != "high-gpu"), F.lit(False))
