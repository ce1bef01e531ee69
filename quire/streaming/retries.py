"""Jobs that call a model and are tried again later, with nothing that waits in a task.

A job is a key of a stateful stream. An attempt that fails for a passing reason sets a timer: 1, 2, 4, ... seconds, up to 30,
and up to one more by the job's own hash, so that jobs that failed together do not come back together and a batch that is run
again does the same. When the timer fires, the job is tried again; after the last attempt, or at once for an error that
trying again will not mend, it ends as a dead letter. State holds only jobs that wait.

Time is the machines' clock, or the stream's own: then timers fire as the watermark passes them, and rows of any job, also of
a job that is nothing but a tick, move it on. A job id that comes again while it waits or after it has ended is a new job of
its own content; rows with a null job_id are left out.

Needs the RocksDB state store: see `prepare`."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

#: Errors that pass; attempts; seconds of the first wait and of the longest.
PASSING = (RuntimeError, ConnectionError, TimeoutError)
ATTEMPTS, FIRST, LONGEST = 5, 1.0, 30.0
TICK = "tick"


def prepare(spark: SparkSession) -> None:
    """Sets the session's state store to the one that timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def wait_ms(job_id: str, attempt: int, first: float = FIRST, longest: float = LONGEST) -> int:
    """How long a job waits after its n-th attempt: doubled each time, with up to `first` added by its hash."""
    share = zlib.crc32(f"{job_id}:{attempt}".encode()) / 2**32
    return int(1000 * min(longest, first * 2 ** (attempt - 1) + first * share))


class _Retrying(StatefulProcessor):
    def __init__(self, call: Callable[[str], str], attempts: int, first: float, longest: float, own_time: bool):
        self.call, self.attempts, self.first, self.longest, self.own_time = call, attempts, first, longest, own_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("waiting", "content string, attempt int, due long")

    def _now(self, times) -> int:
        return times.getCurrentWatermarkInMs() if self.own_time else times.getCurrentProcessingTimeInMs()

    def _tried(self, job_id: str, content: str, attempt: int, now: int) -> tuple | None:
        try:
            return (job_id, attempt, "completed", self.call(content), None)
        except PASSING as e:
            if attempt >= self.attempts:
                return (job_id, attempt, "dead", None, str(e))
            due = now + wait_ms(job_id, attempt, self.first, self.longest)
            self.waiting.update((content, attempt, due))
            self.handle.registerTimer(due)
            return None
        except Exception as e:  # noqa: BLE001  whatever else the call raises ends the job
            return (job_id, attempt, "dead", None, str(e))

    def _out(self, rows: list[tuple | None]) -> Iterator[pd.DataFrame]:
        ended = [r for r in rows if r is not None]
        if ended:
            yield pd.DataFrame(ended, columns=["job_id", "attempts", "status", "result", "error"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        parts = pd.concat(list(rows))
        if key[0] == TICK:
            return
        now = self._now(timerValues)
        if self.own_time:  # the first rows come before there is a watermark
            now = max(now, int(parts["at_ms"].max()))
        if self.waiting.exists():
            self.handle.deleteTimer(self.waiting.get()[2])
            self.waiting.clear()
        # of rows with one id in a batch the largest content counts
        yield from self._out([self._tried(key[0], max(parts["content"], key=lambda c: c or ""), 1, now)])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.waiting.exists():
            return
        content, attempt, due = self.waiting.get()
        self.waiting.clear()
        yield from self._out([self._tried(key[0], content, attempt + 1, max(self._now(timerValues), due))])

    def close(self) -> None:
        pass


def retried(jobs: DataFrame, call: Callable[[str], str], attempts: int = ATTEMPTS, first: float = FIRST, longest: float = LONGEST, own_time: str | None = None) -> DataFrame:
    """job_id, attempts, status (completed or dead), result, error of the jobs of a stream (job_id, content) as they end.

    own_time: a timestamp column that the stream has a watermark on; its time is then the clock."""
    columns = ["job_id", "content", *([F.col(own_time), F.unix_millis(own_time).alias("at_ms")] if own_time else [])]
    out = StructType.fromDDL("job_id string, attempts int, status string, result string, error string")
    processor = _Retrying(call, attempts, first, longest, own_time is not None)
    x = jobs.where(F.col("job_id").isNotNull()).select(*columns).groupBy("job_id")
    return x.transformWithStateInPandas(statefulProcessor=processor, outputStructType=out, outputMode="Append", timeMode="EventTime" if own_time else "ProcessingTime")


def follow(jobs: DataFrame, out: str, checkpoint: str, call: Callable[[str], str], seconds: float = 1.0, **options):
    """Appends jobs that have ended to the Parquet folder `out`; timers are looked at every so many seconds."""
    return retried(jobs, call, **options).writeStream.outputMode("append").option("checkpointLocation", checkpoint).format("parquet").option("path", out).trigger(processingTime=f"{seconds} seconds").start()
