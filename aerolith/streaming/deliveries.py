"""New slice files and NOTAM texts picked up by the file source, each once."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def watch_deliveries(spark: SparkSession, folder: str, schema: StructType, fmt: str = "parquet") -> DataFrame:
    """Stream of the rows of files that appear in a folder, with file and load time."""
    return spark.readStream.format(fmt).schema(schema).load(folder).withColumn("file", F.input_file_name()).withColumn("loaded_at", F.current_timestamp())


def incremental_dedupe(stream: DataFrame, key: Sequence[str], bounded: str | None = None) -> DataFrame:
    """Slices already delivered are dropped; with ``bounded`` (for instance '30 days') the keys are forgotten after that time."""
    if bounded:
        return stream.withWatermark("loaded_at", bounded).dropDuplicatesWithinWatermark(list(key))
    return stream.dropDuplicates(list(key))


def ingest(stream: DataFrame, target: str, checkpoint: str, each: Callable[[DataFrame, int], None] | None = None):
    """Append what is there to a parquet table and stop; the checkpoint makes a re-run continue."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if each is not None:
        return writer.foreachBatch(each).start()
    return writer.format("parquet").option("path", target).outputMode("append").start()
