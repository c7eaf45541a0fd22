"""Subtitle files that arrive in a folder, by the batch functions."""

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cueforge.functions import text as X
from cueforge.operators.segments import transcript
from cueforge.sources.subtitles import srt_segments


def watch_srt(spark: SparkSession, folder: str, target: str, checkpoint: str) -> StreamingQuery:
    """Each SRT file that comes into folder becomes a transcript row in target, by query (which its checkpoint tells) and batch; what is there is taken and then the query ends."""
    files = spark.readStream.format("text").option("wholetext", True).schema("value string").load(folder)
    named = files.select(F.col("_metadata.file_name").alias("video_id"), X.newlines(F.col("value")).alias("document"))

    def batch(df, number):
        # a batch that is run again after a failure replaces its own rows, and no other query's
        query = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
        transcript(srt_segments(df)).write.mode("overwrite").parquet(f"{target}/query={query}/batch={number}")

    return named.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
