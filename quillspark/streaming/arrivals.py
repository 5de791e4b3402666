"""Packages that arrive in a folder, analysed as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType, TimestampType

from ..sources.zip import detect_packages, zip_entries

_FILES = StructType([StructField("path", StringType()), StructField("modificationTime", TimestampType()), StructField("length", LongType()), StructField("content", BinaryType())])


def arriving(spark: SparkSession, folder: str) -> DataFrame:
    """(package_id, content) of the archives in folder, as a stream."""
    return spark.readStream.format("binaryFile").schema(_FILES).load(folder).select(F.col("path").alias("package_id"), "content")


def watch(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Writes kind, entries and bytes of every package that has come; each micro-batch has a folder of its own, so that a repeated one replaces itself."""

    def batch(archives: DataFrame, number: int) -> None:
        entries = zip_entries(archives)
        sizes = entries.groupBy("package_id").agg(F.count("path").alias("entries"), F.sum("uncompressed_size").alias("bytes"), F.count("problem").alias("problems"))
        detect_packages(entries).join(sizes, "package_id").write.mode("overwrite").parquet(f"{out}/batch={number}")

    return arriving(spark, folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
