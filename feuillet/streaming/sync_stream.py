"""Synchronisation and metrics on streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from feuillet.operators.sync import detect_changes


def watch_catalogue(spark: SparkSession, folder: str, schema: StructType, current: Callable[[], DataFrame], apply: Callable[[DataFrame, DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Each new batch of scanned metadata is compared with the catalogue and handed to `apply(batch, changes, epoch)`. Files
    missing from a batch are no deletions, since a batch holds only what is new."""

    def each(batch: DataFrame, epoch: int) -> None:
        latest = batch.groupBy("relative_path").agg(F.max_by("content_hash", "modified_at").alias("content_hash"))
        apply(batch, detect_changes(latest, current()).where("change_type <> 'deleted'"), epoch)

    return spark.readStream.schema(schema).parquet(folder).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def searches_per_window(events: DataFrame, at: str = "received_at", late: str = "1 hour", window: str = "10 minutes") -> DataFrame:
    """Searches, empty results and distinct rows per window of a stream of the history; rows sent twice count once while the
    watermark keeps them."""
    own = events.withWatermark(at, late).dropDuplicatesWithinWatermark(["history_id"])
    return own.groupBy(F.window(at, window)).agg(F.count("*").alias("searches"), F.sum(F.when(F.col("results_count") == 0, 1).otherwise(0)).alias("no_result"))
