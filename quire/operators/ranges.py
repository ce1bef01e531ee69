"""Places in a total order over any number of rows, and pages of it, without one task that sees all rows.

Rows are dealt out by ranges of the order and written once; each range knows its number of rows, so a place is the sum of the
ranges before it and the place inside. What the driver holds is one number for each range."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .durable import checkpointed, read_by, write_by


def _ranged(df: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """df with __part, the range, and __at, the place inside it from 0."""
    x = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    return x.select(*df.columns, F.shiftright("__id", 33).cast("int").alias("__part"), F.col("__id").bitwiseAND(2**33 - 1).alias("__at"))


def numbered(df: DataFrame, order: Sequence[str | Column], name: str = "n") -> DataFrame:
    """Adds the place in the order, from 1. Name columns last in the order that tell all rows apart."""
    x = checkpointed(_ranged(df, order))
    counts = x.groupBy("__part").agg(F.count("*").alias("__rows"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # over ranges
    starts = counts.select("__part", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__start"))
    return x.join(F.broadcast(starts), "__part").withColumn(name, F.col("__start") + F.col("__at") + 1).drop("__part", "__at", "__start")


class Pages:
    """A total order, written once, of which any page is read from the range or two that hold it."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        # one row for each range
        self.counts = {r.part: r.rows for r in spark.read.parquet(f"{folder}/counts").collect()}

    @classmethod
    def write(cls, df: DataFrame, order: Sequence[str | Column], folder: str) -> Pages:
        write_by(_ranged(df, order), f"{folder}/rows", "__part")
        read_by(df.sparkSession, f"{folder}/rows").groupBy(F.col("__part").alias("part")).agg(F.count("*").alias("rows")).write.mode("overwrite").parquet(f"{folder}/counts")
        return cls(df.sparkSession, folder)

    @property
    def total(self) -> int:
        return sum(self.counts.values())

    def rows(self, offset: int, limit: int) -> DataFrame:
        """Rows offset + 1 to offset + limit of the order; only the folders of the ranges that hold them are read."""
        if offset < 0 or limit < 1:
            raise ValueError("offset must be 0 or more and limit 1 or more")
        start, wanted = 0, []
        for part in sorted(self.counts):
            low, high = max(offset - start, 0), min(offset + limit - start, self.counts[part])
            if low < high:
                wanted.append((part, low, high))
            start += self.counts[part]
        x = read_by(self.spark, f"{self.folder}/rows")
        inside = [(F.col("__part") == p) & (F.col("__at") >= low) & (F.col("__at") < high) for p, low, high in wanted]
        x = x.where(F.col("__part").isin([p for p, _, _ in wanted]))
        if not inside:
            return x.drop("__part", "__at")
        which = inside[0]
        for c in inside[1:]:
            which = which | c
        return x.where(which).orderBy("__part", "__at").drop("__part", "__at")

    def page(self, number: int, limit: int = 50, most: int = 500) -> DataFrame:
        if number < 1 or not 1 <= limit <= most:
            raise ValueError(f"page must be 1 or more and limit 1 to {most}")
        return self.rows((number - 1) * limit, limit)


def after(df: DataFrame, order: Sequence[tuple[str, str]], last: dict | None, limit: int) -> DataFrame:
    """The next rows of a total order (column, asc or desc) behind the row `last`, from a top-k of `limit` rows however deep it
    is. Nulls are the smallest values."""
    if any(d not in ("asc", "desc") for _, d in order):
        raise ValueError("order is asc or desc")
    if last is not None:
        behind, equal = F.lit(False), F.lit(True)
        for c, direction in order:
            value, column = F.lit(last[c]), F.col(c)
            if direction == "asc":
                here = column.isNotNull() if last[c] is None else column > value
            else:
                here = F.lit(False) if last[c] is None else (column < value) | column.isNull()
            behind = behind | (equal & F.coalesce(here, F.lit(False)))
            equal = equal & column.eqNullSafe(value)
        df = df.where(behind)
    return df.orderBy(*[F.col(c).asc() if d == "asc" else F.col(c).desc() for c, d in order]).limit(limit)
