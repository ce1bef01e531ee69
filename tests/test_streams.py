"""Ingest and retries as streams: replays, deaths between writes, timers by the stream's own time."""

import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quire.operators import chunks
from quire.streaming import ingest, retries


def embedder():
    def embed(texts):
        return [[float(len(t)), float(t.count("a"))] for t in texts]

    return embed


embed = embedder()  # made inside a function, so that it travels to workers by value


def batch(spark, rows):
    return spark.createDataFrame(rows, "id string, full_text string, updated int, extra string")


FIRST = [("s1", "alpha beta. " * 900, 1, "x"), ("s2", "short", 1, None), ("s3", None, 1, None), ("s4", "", 1, None), (None, "nobody's", 1, None), ("s2", "short", 1, None), ("s2", "older", 0, None)]
SECOND = [("s1", "now this", 2, None), ("s5", "five", 1, None)]


def expected(*batches):
    last = {}
    for rows in batches:
        here = {}
        for i, text, updated, _ in rows:
            if i is not None:
                here[i] = max(here.get(i, (-1, "")), (updated, text or ""))
        last |= here
    return sorted((i, n, c) for i, (_, text) in last.items() if text.strip() for n, c in enumerate(chunks.split_text(text)))


def have(spark, folder):
    rows = ingest.current(spark, folder).collect()
    assert all(r.embedding == embed([r.content])[0] for r in rows)
    return sorted((r.source, r.order, r.content) for r in rows)


def test_replayed_batch_changes_nothing(spark, tmp_path):
    folder = str(tmp_path)
    assert have(spark, folder) == []
    assert ingest.take(batch(spark, FIRST), 0, folder, embed)
    assert have(spark, folder) == expected(FIRST)
    assert not ingest.take(batch(spark, SECOND), 0, folder, embed)  # the number has been taken
    assert have(spark, folder) == expected(FIRST)
    assert ingest.take(batch(spark, SECOND), 1, folder, embed)
    assert have(spark, folder) == expected(FIRST, SECOND)
    jobs = ingest.jobs(spark, folder)
    assert jobs.count() == jobs.select("job_id").distinct().count() == len(expected(FIRST)) + 2
    assert {r.source: (r.processed, r.failed, r.total) for r in ingest.progress(spark, folder).collect()} == {"s1": (1, 0, 1), "s2": (1, 0, 1), "s3": (0, 0, 0), "s4": (0, 0, 0), "s5": (1, 0, 1)}


@pytest.mark.parametrize("dies_at", ["chunks", "jobs", "ledger"])
def test_batch_that_dies_between_its_writes(spark, tmp_path, monkeypatch, dies_at):
    folder, write = str(tmp_path), ingest._write
    ingest.take(batch(spark, FIRST), 0, folder, embed)

    def dying(df, where, name, number):
        if name == dies_at:
            raise OSError("the machine is gone")
        write(df, where, name, number)

    monkeypatch.setattr(ingest, "_write", dying)
    with pytest.raises(OSError):
        ingest.take(batch(spark, SECOND), 1, folder, embed)
    assert have(spark, folder) == expected(FIRST)  # nobody sees half a batch
    monkeypatch.setattr(ingest, "_write", write)
    assert ingest.take(batch(spark, SECOND), 1, folder, embed)
    assert have(spark, folder) == expected(FIRST, SECOND)


def test_chunks_that_fail_are_told(spark, tmp_path):
    embed = embedder()

    def picky(texts):
        if any("short" in t for t in texts):
            raise ValueError("refused")
        return embed(texts)

    ingest.take(batch(spark, FIRST), 0, str(tmp_path), picky)
    jobs = {(r.source, r.status, r.error) for r in ingest.jobs(spark, str(tmp_path)).collect()}
    assert jobs == {("s1", "completed", None), ("s2", "failed", "refused")}
    assert {r.source for r in ingest.current(spark, str(tmp_path)).collect()} == {"s1"}


def test_ingest_as_a_stream(spark, tmp_path):
    arriving, folder, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for rows in (FIRST, SECOND):
        batch(spark, rows).coalesce(1).write.mode("append").parquet(arriving)
        stream = spark.readStream.schema("id string, full_text string, updated int, extra string").parquet(arriving)
        ingest.follow(stream, folder, state, embed).awaitTermination()
    assert have(spark, folder) == expected(FIRST, SECOND)


def test_waits_grow_and_differ():
    waits = [retries.wait_ms("job", n) for n in range(1, 9)]
    assert all(1000 * min(30, 2 ** (n - 1)) <= w <= 1000 * min(30, 2 ** (n - 1) + 1) for n, w in enumerate(waits, 1))
    assert len({retries.wait_ms(f"job{i}", 1) for i in range(20)}) > 10
    assert retries.wait_ms("job", 3) == retries.wait_ms("job", 3)


def test_jobs_are_tried_again_by_the_streams_own_time(spark, tmp_path):
    """`later` fails as long as its log has fewer than two lines, `never` always, `wrong` for good."""
    log = tmp_path / "tries"
    log.mkdir()

    def call(content):
        with (log / content).open("a") as f:
            f.write("x")
        tries = len((log / content).read_text())
        if content == "wrong":
            raise ValueError("no such thing")
        if content == "never" or content == "later" and tries < 3:
            raise ConnectionError(f"try {tries}")
        return content.upper()

    start = datetime(2024, 1, 1)
    arriving, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "job_id string, content string, at timestamp"
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    retries.prepare(spark)
    try:
        def step(seconds, *jobs):
            at = start + timedelta(seconds=seconds)
            rows = [(j, c, at) for j, c in jobs] + [(retries.TICK, None, at)]
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(arriving)
            stream = spark.readStream.schema(schema).parquet(arriving).withWatermark("at", "0 seconds")
            q = retries.retried(stream, call, attempts=3, own_time="at")
            began = time.time()
            q.writeStream.outputMode("append").option("checkpointLocation", state).format("parquet").option("path", out).trigger(availableNow=True).start().awaitTermination()
            return time.time() - began

        step(0, ("a", "fine"), ("b", "later"), ("c", "never"), ("d", "wrong"), (None, "fine"))
        ended = lambda: {r.job_id: (r.attempts, r.status, r.result, r.error) for r in spark.read.parquet(out).collect()}
        assert ended() == {"a": (1, "completed", "FINE", None), "d": (1, "dead", None, "no such thing")}
        step(3)
        assert set(ended()) == {"a", "d"} and len((log / "later").read_text()) == 2
        step(20)
        assert ended()["b"] == (3, "completed", "LATER", None)
        assert ended()["c"] == (3, "dead", None, "try 3")
        step(60)
        assert len(ended()) == spark.read.parquet(out).count() == 4
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
