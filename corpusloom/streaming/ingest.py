"""Incremental ingest: a file stream whose contents enter a ledger exactly once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..operators.ingest import first_by_hash, new_only, with_hash


def _ledger(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def ingest_stream(spark: SparkSession, source: str, schema: StructType, ledger: str, checkpoint: str, *, key: str, accept: Column | None = None, files: int = 4) -> StreamingQuery:
    """Reads Parquet files as they come and appends rows of new content to the ledger until none is left.

    Every batch writes a folder of its own, named by its number, and overwrites it if the batch is run again: a
    batch that failed half-way leaves no second copy. Content is new if no earlier batch's folder holds its hash.
    """
    rows = with_hash(spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source))
    if accept is not None:
        rows = rows.filter(accept)
    out = StructType([*schema.fields, StructField("sha", StringType()), StructField("batch", IntegerType())])

    def append(batch: DataFrame, number: int) -> None:
        before = _ledger(batch.sparkSession, ledger, out).filter(F.col("batch") < number)
        fresh = new_only(first_by_hash(batch, "sha", key), before)
        fresh.write.mode("overwrite").parquet(f"{ledger}/batch={number}")

    return rows.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """Events and users by window and kind, for streams as for tables; later events than that are left out of a stream."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    w = events.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n", "value")
