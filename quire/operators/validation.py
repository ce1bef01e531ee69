"""Rows that are checked before they are taken in: `valid`, and `reject_reason`, the first rule that a row breaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bounds of episodes and speakers, and what each speaker must have.
SEGMENTS, SPEAKERS = (3, 20), (1, 4)
SPEAKER_KEYS = ["name", "voice_id", "backstory", "personality"]
#: Kinds of sources and the field that each needs.
KINDS = {"link": "url", "upload": "file_path", "text": "content"}


def checked(rows: DataFrame, rules: list[tuple[str | Column, Column]]) -> DataFrame:
    """rules: reason and what must be true; null counts as false."""
    broken = F.coalesce(F.lit(None).cast("string"), *[F.when(~F.coalesce(ok, F.lit(False)), F.lit(reason) if isinstance(reason, str) else reason) for reason, ok in rules])
    return rows.withColumn("reject_reason", broken).withColumn("valid", F.col("reject_reason").isNull())


def _filled(c: Column) -> Column:
    return F.trim(c) != ""


def _first_of_name(rows: DataFrame) -> DataFrame:
    """Adds __first, the smallest id that has the row's name; names are compared as they are."""
    first = rows.where(F.col("name").isNotNull()).groupBy(F.col("name").alias("__name")).agg(F.min("id").alias("__first"))
    return rows.join(first, F.col("name") == F.col("__name"), "left").drop("__name")


def _unique() -> tuple[str, Column]:
    return "name is taken", F.col("id") == F.col("__first")


def episode_profiles(rows: DataFrame) -> DataFrame:
    """Checks episode profiles (id, name, num_segments; a missing number is the default 5)."""
    segments = F.coalesce("num_segments", F.lit(5))
    rules = [("name is required", _filled(F.col("name"))), (f"Number of segments must be between {SEGMENTS[0]} and {SEGMENTS[1]}", segments.between(*SEGMENTS)), _unique()]
    return checked(_first_of_name(rows), rules).drop("__first")


def speaker_profiles(rows: DataFrame) -> DataFrame:
    """Checks speaker profiles (id, name, speakers as an array of maps): a key counts if it is there, whatever its value."""
    count = F.coalesce(F.size("speakers"), F.lit(0))
    lacking = F.flatten(F.transform("speakers", lambda s: F.filter(F.array(*map(F.lit, SPEAKER_KEYS)), lambda k: ~F.coalesce(F.map_contains_key(s, k), F.lit(False)))))
    rules = [
        ("name is required", _filled(F.col("name"))), (f"Must have between {SPEAKERS[0]} and {SPEAKERS[1]} speakers", count.between(*SPEAKERS)),
        (F.concat(F.lit("Speaker missing required field: "), F.get(lacking, F.lit(0))), F.size(lacking) == 0), _unique(),
    ]
    return checked(_first_of_name(rows), rules).drop("__first")


def source_requests(rows: DataFrame) -> DataFrame:
    """Checks requests for sources (type, url, file_path, content): a known kind, with the field of its kind and no other."""
    has = {c: F.coalesce(_filled(F.col(c)), F.lit(False)) for c in KINDS.values()}
    own, others = F.lit(False), F.lit(False)
    for kind, c in KINDS.items():
        own = F.when(F.col("type") == kind, has[c]).otherwise(own)
        others = F.when(F.col("type") == kind, F.exists(F.array(*[v for k, v in has.items() if k != c]), lambda x: x)).otherwise(others)
    needed = F.concat(F.element_at(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv]), F.col("type")), F.lit(" is required for type "), F.col("type"))
    return checked(rows, [("type must be link, upload or text", F.col("type").isin(*KINDS)), (needed, own), ("only one of url, file_path and content may be given", ~others)])
