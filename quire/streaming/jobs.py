"""Job states from a log of events, as a batch and as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ACTIVE = ("new", "queued", "running")


def latest_status(log: DataFrame) -> DataFrame:
    """job_id, status, ts of each job's last event (ties: larger event_id). Partial maxima are taken before the shuffle.

    The same plan runs over a stream: write it with outputMode("update")."""
    last = F.max(F.struct("ts", "event_id", "status")).alias("last")
    return log.groupBy("job_id").agg(last).select("job_id", "last.status", "last.ts")


def submitted(log: DataFrame, jobs: DataFrame, now) -> DataFrame:
    """The log with an event `new` for each job of jobs (job_id, once each) that it does not know yet."""
    fresh = jobs.select("job_id").distinct().join(log.select("job_id").distinct(), "job_id", "left_anti")
    event = fresh.select("job_id", F.lit(None).cast("long").alias("event_id"), F.lit(now).cast("timestamp").alias("ts"), F.lit("new").alias("status"))
    return log.unionByName(event, allowMissingColumns=True)


def status_of(jobs: DataFrame, log: DataFrame, key: str = "job_id") -> DataFrame:
    """jobs with their status, unknown where there is no event."""
    return jobs.join(latest_status(log).select(F.col("job_id").alias(key), "status"), key, "left").withColumn("status", F.coalesce("status", F.lit("unknown")))


def listed(log: DataFrame, status: str | None = None, limit: int = 50) -> DataFrame:
    x = latest_status(log)
    return (x.where(F.col("status") == status) if status else x).orderBy(F.col("ts").desc(), "job_id").limit(limit)


def progress(log: DataFrame) -> DataFrame:
    """job_id, processed, failed, total and percent of the events that are done."""
    x = log.groupBy("job_id").agg(F.count_if(F.col("status") == "completed").alias("processed"), F.count_if(F.col("status") == "failed").alias("failed"), F.count("*").alias("total"))
    return x.withColumn("percent", F.when(F.col("total") > 0, F.round(100.0 * F.col("processed") / F.col("total"), 2)).otherwise(0.0))


def cancelled(log: DataFrame, jobs: DataFrame, now) -> DataFrame:
    """The log with an event that cancels each active job of jobs (job_id)."""
    x = latest_status(log).where(F.col("status").isin(*ACTIVE)).join(jobs.select("job_id").distinct(), "job_id", "left_semi")
    event = x.select("job_id", F.lit(None).cast("long").alias("event_id"), F.lit(now).cast("timestamp").alias("ts"), F.lit("cancelled").alias("status"))
    return log.unionByName(event, allowMissingColumns=True)


def follow(events: DataFrame, out: str, checkpoint: str, once: bool = True):
    """Keeps the latest states of a stream of events in the Parquet folder `out`, one subfolder for each batch of changes."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    q = latest_status(events).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)
    return (q.trigger(availableNow=True) if once else q.trigger(processingTime="2 seconds")).start()


def appended(messages: DataFrame, new: DataFrame, order: str = "at") -> DataFrame:
    """messages (thread, n, role, text) and those of new (thread, role, text, and their order), numbered on from each thread's last.

    What a thread holds is never gathered: its last number is a partial maximum."""
    last = messages.groupBy(F.col("thread").alias("__t")).agg(F.max("n").alias("__last"))
    n = F.row_number().over(Window.partitionBy("thread").orderBy(order, "role", "text"))
    x = new.withColumn("__n", n).join(last, F.col("thread") == F.col("__t"), "left")
    return messages.select("thread", "n", "role", "text").unionByName(x.select("thread", (F.col("__n") + F.coalesce("__last", F.lit(0))).cast("long").alias("n"), "role", "text"))


def numbered(stream: DataFrame) -> DataFrame:
    """A stream of messages (thread, at, role, text) numbered in each thread; the state of a thread is its last number."""

    def run(key, batches: Iterator[pd.DataFrame], state):
        last = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values(["at", "role", "text"])
        state.update((last + len(rows),))
        yield pd.DataFrame({"thread": rows["thread"], "n": range(last + 1, last + 1 + len(rows)), "role": rows["role"], "text": rows["text"]})

    return stream.groupBy("thread").applyInPandasWithState(run, "thread string, n long, role string, text string", "last long", "append", "NoTimeout")


def follow_threads(stream: DataFrame, out: str, checkpoint: str):
    """Appends the numbered messages of a stream to the Parquet folder `out`."""
    q = numbered(stream).writeStream.outputMode("append").option("checkpointLocation", checkpoint).format("parquet").option("path", out)
    return q.trigger(availableNow=True).start()
