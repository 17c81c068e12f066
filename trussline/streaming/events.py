"""Structured Streaming forms of the log's roll-ups; over all rows each equals its batch form."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trussline.operators.graph import shared_folder

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
LATE = "2 days"


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    """The events table as a stream of files; ts as a timestamp of the session's zone."""
    batch = spark.read.parquet(f"{folder}/events.parquet")
    return spark.readStream.schema(batch.schema).option("pathGlobFilter", "events.parquet").parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def marked(events: DataFrame, late: str = LATE) -> DataFrame:
    return events.withWatermark("ts", late) if events.isStreaming else events


def windowed(events: DataFrame, length: str = "1 day", late: str = LATE) -> DataFrame:
    """start, event_type, n, total: tumbling windows; rows later than `late` are dropped once the watermark has passed."""
    sums = marked(events, late).groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.min("value").alias("low"), F.max("value").alias("high"))
    return sums.select(F.col("window.start").alias("start"), "event_type", "n", "total", "low", "high")


def rolling(events: DataFrame, length: str = "7 days", step: str = "1 day", late: str = "8 days") -> DataFrame:
    """start, file_key, n, mean, worst: look-back windows of `length`, one every `step`, of each file."""
    sums = marked(events, late).groupBy(F.window("ts", length, step), "file_key").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.max("value").alias("worst"))
    return sums.select(F.col("window.start").alias("start"), "file_key", "n", "mean", "worst")


def run_counters(events: DataFrame, runs: int = 97) -> DataFrame:
    """run_id, ok, failed: counters that each job event bumps, an event that comes twice once."""
    jobs = marked(events).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])
    failed = F.col("value") > 75
    return jobs.groupBy((F.col("event_id") % runs).alias("run_id")).agg(F.count_if(~failed).alias("ok"), F.count_if(failed).alias("failed"))


def run_states(counters: DataFrame, totals: DataFrame) -> DataFrame:
    """Adds total, aborted and state by totals (run_id, total, aborted): aborted runs stay aborted, others have ended once all their jobs are counted."""
    rows = counters.join(totals, "run_id")
    ended = F.col("ok") + F.col("failed") >= F.col("total")
    return rows.withColumn("state", F.when(F.col("aborted"), "aborted").when(ended, "ended").otherwise("running"))


def heartbeats(samples: DataFrame, length: str = "1 hour") -> DataFrame:
    """start, job_id, n, mean, peak of the samples that jobs send while they run."""
    sums = marked(samples).groupBy(F.window("ts", length), "job_id").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.max("value").alias("peak"))
    return sums.select(F.col("window.start").alias("start"), "job_id", "n", "mean", "peak")


def running_ranges(steps: DataFrame) -> DataFrame:
    """field, low, high over the result steps that have come so far; values that aren't finite don't count."""
    finite = F.when(~F.isnan("value") & (F.abs("value") < float("inf")), F.col("value"))
    return steps.groupBy("field").agg(F.min(finite).alias("low"), F.max(finite).alias("high"))


def failure_counts(failures: DataFrame, print_: Column) -> DataFrame:
    """fingerprint, n, first_seen: the first failure of a kind opens it, later ones count."""
    return failures.groupBy(print_.alias("fingerprint")).agg(F.count("*").alias("n"), F.min("ts").alias("first_seen"))


def run_to_end(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Runs a stream of roll-ups over what is there and gives the last state of each key.

    Each micro-batch writes the rows it changed to its own folder (written over when a batch is repeated), so nothing is gathered on the driver; the
    stream's own state and log are kept beside it. Both are in the shared folder.
    """
    spark = df.sparkSession
    base = f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"

    def write(rows: DataFrame, batch: int) -> None:
        rows.withColumn("__batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(f"{base}/out/batch={batch}")

    query = df.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    written = spark.read.schema(df.select("*").schema.add("__batch", "long")).parquet(f"{base}/out/*")
    newest = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("__batch")))
    return written.withColumn("__rank", newest).where("__rank = 1").select(*df.columns)
