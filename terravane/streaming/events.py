"""Structured Streaming forms of the batch operators; extensions of the reference, which has no stream runtime."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terravane.operators.territory import merge_incidents


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """The event table as a stream of files, with a time stamp a watermark accepts."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def hourly(events: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Tumbling hourly counts and means per type; a window closes ``lateness`` after its end."""
    w = events.withWatermark("ts", lateness).groupBy(F.window("ts", "1 hour"), "event_type")
    return w.agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select(F.col("window.start").alias("hour"), "event_type", "n", "mean")


def sessions(events: DataFrame, gap: str = "30 minutes", lateness: str = "1 hour") -> DataFrame:
    w = events.withWatermark("ts", lateness).groupBy(F.session_window("ts", gap), "user_id")
    return w.agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def distinct_events(events: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Each event once, with bounded state."""
    return events.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["event_id"])


def incident_sink(matches_of, state_path: str):  # noqa: ANN001, ANN201
    """A foreachBatch function: merges the matches of each batch into the incident state, one version of the state per batch.

    ``matches_of(batch)`` gives (matches, evaluated). A repeated batch writes its version again, so reruns do no harm.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        empty = "fingerprint string, key string, rule_id int, severity string, status string, occurrences int, run string"
        state = spark.createDataFrame([], empty) if number == 0 else spark.read.schema(empty).parquet(f"{state_path}/v={number - 1}")
        matches, evaluated = matches_of(batch)
        merge_incidents(state, matches, evaluated, F.lit(f"batch{number}")).write.mode("overwrite").parquet(f"{state_path}/v={number}")

    return run
