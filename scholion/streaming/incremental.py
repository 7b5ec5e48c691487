"""The daily run as a stream: papers arrive in files, are scored, freed of what is known, and added to the history."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholion.operators import matching


def arrivals(spark: SparkSession, folder: str, schema, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def first_seen(stream: DataFrame, key: str, time: str, keep: str = "30 days") -> DataFrame:
    """The first arrival of each key; a key is forgotten ``keep`` after it was last seen, so the state stays bounded."""
    return stream.where(F.col(key).isNotNull()).withWatermark(time, keep).dropDuplicatesWithinWatermark([key])


def daily_counts(stream: DataFrame, time: str, by: str, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Rows in tumbling windows; rows later than ``late`` are no longer counted."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), by).count().select(F.col("window.start").alias("start"), by, "count")


def sessions(stream: DataFrame, time: str, by: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap), by).count().select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), by, "count")


def scored(stream: DataFrame, rules: matching.Rules) -> DataFrame:
    """Stateless: the scoring expressions run on streams as they do on tables."""
    return matching.score(stream, rules).where(F.col("points") >= rules.min_score)


def run_batches(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str):
    """Runs ``each`` on what has arrived, once a batch, and stops; a repeated batch has the same number."""
    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
