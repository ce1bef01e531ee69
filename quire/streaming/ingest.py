"""Sources that arrive as a stream become chunks with vectors, a job row for each chunk, and nothing twice.

Each micro-batch writes folders of its own number, then one row to the ledger. A batch whose row is there is passed over when
it comes again; one that died before that is done again over what it left. Readers see committed batches only, and of each
source the chunks of its latest one, so a source that comes again with another text loses its old chunks.

    sources  source                       of the batch, with text or without
    chunks   source, order, content, embedding
    jobs     job_id, source, order, status, error     completed, or failed by an error that is no reason to try again
    ledger   sources, chunks, failed      written last

Of rows with one id in a batch the last by `updated` counts (ties: the larger text). Null ids are passed over; null and blank
texts have no chunks. Models are called on whole Arrow batches inside tasks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunks
from ..operators.models import attempted
from ..operators.relational import latest

SCHEMAS = {
    "sources": "source string, batch long",
    "chunks": "source string, `order` long, content string, embedding array<double>, batch long",
    "jobs": "job_id string, source string, `order` long, status string, error string, batch long",
    "ledger": "sources long, chunks long, failed long, batch long",
}


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    if not _exists(spark, f"{folder}/{name}"):
        return spark.createDataFrame([], SCHEMAS[name])
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}")


def _committed(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return _table(spark, folder, name).join(_table(spark, folder, "ledger").select("batch"), "batch", "left_semi")


def _write(df: DataFrame, folder: str, name: str, batch: int) -> None:
    df.write.mode("overwrite").parquet(f"{folder}/{name}/batch={batch}")


def take(batch: DataFrame, number: int, folder: str, embed: Callable[[list[str]], list[list[float]]], retries: int = 1) -> bool:
    """Takes in one batch of sources (id, full_text, updated); False if it has been taken in before."""
    spark = batch.sparkSession
    if _exists(spark, f"{folder}/ledger/batch={number}/_SUCCESS"):
        return False
    rows = latest(batch.where(F.col("id").isNotNull()).select(F.col("id").alias("source"), "updated", "full_text"), "source", ["updated", "full_text"])
    _write(rows.select("source"), folder, "sources", number)
    # models are asked once: what they gave is written with its errors, and both tables are read from there
    pieces = chunks.chunked(rows, "source", "full_text").select(F.col("id").alias("source"), F.col("order").cast("long").alias("order"), "content")
    made = attempted(pieces, embed, "content", retries)
    _write(made, folder, "made", number)
    made = spark.read.parquet(f"{folder}/made/batch={number}")
    _write(made.where(F.col("error").isNull()).select("source", "order", "content", "embedding"), folder, "chunks", number)
    job = F.concat_ws(":", F.lit("embed_chunk"), "source", "order", F.lit(str(number)))
    _write(made.select(job.alias("job_id"), "source", "order", F.when(F.col("error").isNull(), "completed").otherwise("failed").alias("status"), "error"), folder, "jobs", number)
    counts = made.agg(F.count_if(F.col("error").isNull()).alias("chunks"), F.count_if(F.col("error").isNotNull()).alias("failed"))
    total = spark.read.parquet(f"{folder}/sources/batch={number}").agg(F.count("*").alias("sources"))
    _write(total.join(F.broadcast(counts)).coalesce(1), folder, "ledger", number)  # one row
    return True


def follow(stream: DataFrame, folder: str, checkpoint: str, embed: Callable[[list[str]], list[list[float]]], retries: int = 1, once: bool = True):
    """Takes in a stream of sources (id, full_text, updated)."""
    q = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda b, n: take(b, n, folder, embed, retries) and None)
    return (q.trigger(availableNow=True) if once else q.trigger(processingTime="2 seconds")).start()


def current(spark: SparkSession, folder: str) -> DataFrame:
    """source, order, content, embedding of each source's latest batch."""
    last = _committed(spark, folder, "sources").groupBy("source").agg(F.max("batch").alias("batch"))
    return _committed(spark, folder, "chunks").join(last, ["source", "batch"], "left_semi").select("source", "order", "content", "embedding")


def jobs(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each chunk that was ever embedded or failed to be."""
    return _committed(spark, folder, "jobs")


def progress(spark: SparkSession, folder: str) -> DataFrame:
    """source, processed, failed, total of each source's latest batch; a source without chunks has zeros."""
    last = _committed(spark, folder, "sources").groupBy("source").agg(F.max("batch").alias("batch"))
    x = last.join(_committed(spark, folder, "jobs"), ["source", "batch"], "left")
    return x.groupBy("source").agg(F.count_if(F.col("status") == "completed").alias("processed"), F.count_if(F.col("status") == "failed").alias("failed"), F.count("status").alias("total"))
