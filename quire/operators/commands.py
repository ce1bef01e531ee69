"""Commands with typed input and output: a name, what rows it takes, what rows it gives, and the function between."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .models import attempted
from .validation import checked


@dataclass(frozen=True)
class Command:
    """takes and gives are column lists of SQL; a column that is NOT NULL is required. The function keeps `key` columns apart."""

    app: str
    name: str
    takes: str
    gives: str
    run: Callable[..., DataFrame]


def _schema(columns: str) -> StructType:
    return StructType.fromDDL(columns)


def _typed(rows: DataFrame, columns: str, what: str, kept: list[str]) -> DataFrame:
    """rows with the columns in their types; an error if one is missing. Values that no cast can make are null."""
    wanted = _schema(columns)
    missing = [f.name for f in wanted if f.name not in rows.columns]
    if missing:
        raise ValueError(f"{what} lacks {', '.join(missing)}")
    return rows.select(*kept, *[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in wanted if f.name not in kept])


def _required(columns: str) -> list[tuple[str, Column]]:
    return [(f"{f.name} is required", F.col(f"`{f.name}`").isNotNull()) for f in _schema(columns) if not f.nullable]


def call(command: Command, rows: DataFrame, key: str, **context) -> DataFrame:
    """key, success, error and what the command gives, for each row (key: unique). A row without a required value, or with one
    that is not of its type, does not reach the function and says why; what it gives is null."""
    asked = checked(_typed(rows, command.takes, f"input of {command.name}", [key]), _required(command.takes))
    fits = asked.where("valid").drop("valid", "reject_reason")
    made = command.run(fits, **context)
    failed = F.col("error") if "error" in made.columns else F.lit(None).cast("string")
    names = [f.name for f in _schema(command.gives)]
    made = _typed(made.withColumn("error", failed), command.gives, f"output of {command.name}", [key, "error"])
    done = made.select(key, F.col("error").isNull().alias("success"), "error", *names)
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in _schema(command.gives)]
    return done.unionByName(asked.where("NOT valid").select(key, F.lit(False).alias("success"), F.col("reject_reason").alias("error"), *empty))


def listing(spark: SparkSession, commands: list[Command]) -> DataFrame:
    """app, name, takes, gives of each command; a name that an app has twice is an error."""
    names = [(c.app, c.name) for c in commands]
    if len(set(names)) < len(names):
        raise ValueError("an app has two commands of one name")
    return spark.createDataFrame([(c.app, c.name, _schema(c.takes).simpleString(), _schema(c.gives).simpleString()) for c in commands], "app string, name string, takes string, gives string")


def _embed_chunk(rows: DataFrame, embed: Callable[[list[str]], list[list[float]]], retries: int = 1) -> DataFrame:
    return attempted(rows, embed, "chunk_text", retries)


#: One chunk's vector.
EMBED_CHUNK = Command("quire", "embed_chunk", "source_id STRING NOT NULL, chunk_index INT NOT NULL, chunk_text STRING NOT NULL", "source_id STRING, chunk_index INT, embedding ARRAY<DOUBLE>", _embed_chunk)
