"""Continuous refresh: a stream of file inventories drives the same diff and upsert as a batch update, and windowed counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.incremental import diff_manifest
from ..sources.records import read_manifest


def refresh(snapshots: DataFrame, manifest: str, checkpoint: str, apply: Callable[[DataFrame, DataFrame], None]) -> StreamingQuery:
    """For every micro-batch of (source_file, sha256_hash, size_bytes): diff against the stored manifest, hand (batch, diff) to
    ``apply``, and store the manifest with the batch's files replaced. A batch names changed files only; files it does not
    name stay as they are. Manifests are numbered by batch, so a batch that runs again after a failure reads the same one.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = read_manifest(spark, f"{manifest}/{number - 1}") if number else spark.createDataFrame([], "source_file string, sha256_hash string, size_bytes long")
        new = batch.select("source_file", "sha256_hash", "size_bytes").dropDuplicates(["source_file"])
        known = old.join(new.select("source_file"), "source_file", "left_semi")
        diff = diff_manifest(known, new)
        apply(batch, diff.where("status <> 'unchanged'"))
        merged = old.join(new.select("source_file"), "source_file", "left_anti").select(*new.columns).unionByName(new)
        merged.write.mode("overwrite").parquet(f"{manifest}/{number}")

    return snapshots.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums per tumbling window and type; rows later than the watermark are left out when windows have closed."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def run_windowed(spark: SparkSession, folder: str, name: str = "events", width: str = "1 hour") -> DataFrame:
    """Streams a Parquet table to its end and gives the complete windows as a table."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    query = windowed(stream, width).writeStream.outputMode("complete").format("memory").queryName(f"{name}_windows").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(f"{name}_windows")
