"""Landing folders as streams: new scans are matched and new differences counted as they arrive.

The reference capability is batch only; these entry points run the same operators
over micro-batches and are an addition.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cartulary.operators import matching as M


def landed_files(spark: SparkSession, folder: str, schema: str | object) -> DataFrame:
    """Parquet parts as they land in a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def scans_per_window(files: DataFrame, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Files and bytes per source and window of scan time; scans later than the watermark are left out."""
    at = F.col("scanned_at").cast("timestamp")
    timed = files.withColumn("at", at).withWatermark("at", late)
    return timed.groupBy(F.window("at", window), "source").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def match_stream(files: DataFrame, members: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Match each micro-batch of scanned files to the members and hand the matches to ``sink``."""
    def each(batch: DataFrame, number: int) -> None:
        sink(M.tiered_match(members, M.scanned_files(batch)), number)

    return files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
