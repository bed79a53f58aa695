"""The same tables over files as they arrive.

Every step is a stateless map of one file, so no watermark is needed and a file is
parsed once; per-image aggregates run on each micro-batch, as an image is one file.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType, TimestampType

from ..sources.files import PATTERN, table

SCHEMA = StructType([StructField("path", StringType()), StructField("modificationTime", TimestampType()), StructField("length", LongType()), StructField("content", BinaryType())])


def arriving(spark: SparkSession, folder: str, most_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.format("binaryFile").schema(SCHEMA).option("pathGlobFilter", PATTERN).option("maxFilesPerTrigger", most_per_trigger).load(folder)


def stream_table(spark: SparkSession, folder: str, name: str, target: str, checkpoint: str):
    """Append a table of the files that arrive as Parquet; ends when all there are read."""
    rows = table(arriving(spark, folder), name)
    return rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def for_each_batch(spark: SparkSession, folder: str, checkpoint: str, work: Callable[[DataFrame, int], None]):
    """Whole-image work (ranges, planes, checks) on each batch of files."""
    return arriving(spark, folder).writeStream.option("checkpointLocation", checkpoint).foreachBatch(work).trigger(availableNow=True).start()
