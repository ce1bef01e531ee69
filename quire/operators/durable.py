"""Cutting lineage so that it survives lost executors."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def checkpointed(df: DataFrame) -> DataFrame:
    """Writes df to the folder in spark.checkpoint.dir, which all machines share, and reads it from there."""
    _checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new place for tables in the folder that all machines share."""
    return f"{_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def write_by(df: DataFrame, path: str, by: str) -> None:
    """Writes df in folders of the column `by`, and its columns beside it, which a table without rows would not show."""
    df.write.mode("overwrite").partitionBy(by).parquet(path)
    df.sparkSession.createDataFrame([(df.schema.json(),)], "columns string").coalesce(1).write.mode("overwrite").parquet(f"{path}-columns")


def read_by(spark: SparkSession, path: str) -> DataFrame:
    columns = spark.read.parquet(f"{path}-columns").first().columns
    return spark.read.schema(StructType.fromJson(json.loads(columns))).parquet(path)


def _checkpoint_dir(spark: SparkSession) -> str:
    """Only a local session that names no such folder gets one of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if named is None and not (sc.master or "").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoints-"))
    return sc.getCheckpointDir()
