"""Link joins, counts, filters, paging and statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def linked(edges: DataFrame, targets: DataFrame, out: str | Column | None = None) -> DataFrame:
    """Targets at the `in` end of edges, once for each edge; `out` restricts the other end. Keeps the edge's out as `parent`."""
    e = edges if out is None else edges.where(F.col("out") == out)
    return e.select(F.col("in").alias("__in"), F.col("out").alias("parent")).join(targets, F.col("__in") == F.col("id")).drop("__in")


def with_count(base: DataFrame, child: DataFrame, key: str, name: str) -> DataFrame:
    """Adds how many rows of child have base.id in `key`; 0 for none."""
    n = child.groupBy(F.col(key).alias("__key")).agg(F.count("*").alias(name))
    return base.join(n, F.col("id") == F.col("__key"), "left").drop("__key").withColumn(name, F.coalesce(name, F.lit(0)).cast("long"))


def with_mark(base: DataFrame, child: DataFrame, key: str, name: str) -> DataFrame:
    """Adds whether any row of child has base.id in `key`."""
    some = child.select(F.col(key).alias("__key")).distinct()
    return base.join(some, F.col("id") == F.col("__key"), "left").withColumn(name, F.col("__key").isNotNull()).drop("__key")


def equal(df: DataFrame, **values) -> DataFrame:
    """Rows that have all the values; None and '' ask for nothing."""
    for c, v in values.items():
        if v is not None and v != "":
            df = df.where(F.col(c) == F.lit(v))
    return df


def same_ignoring_case(df: DataFrame, **values: str) -> DataFrame:
    for c, v in values.items():
        df = df.where(F.lower(c) == v.lower())
    return df


def contains_text(df: DataFrame, column: str, text: str) -> DataFrame:
    """Case-insensitive substring filter; a blank text filters nothing."""
    text = text.strip().lower()
    return df.where(F.contains(F.lower(column), F.lit(text))) if text else df


def archived(df: DataFrame, flag: bool) -> DataFrame:
    """Exact equality: rows without the flag match neither value."""
    return df.where(F.col("archived") == flag)


def page(df: DataFrame, order: list, number: int = 1, limit: int = 50, most: int = 500) -> DataFrame:
    """One page of a total order (name a unique column last): a distributed top-k of offset + limit rows."""
    if number < 1 or not 1 <= limit <= most:
        raise ValueError(f"page must be 1 or more and limit 1 to {most}")
    return df.orderBy(*order).offset((number - 1) * limit).limit(limit)


def sorted_by(df: DataFrame, column: str, direction: str, allowed: tuple[str, ...], limit: int, offset: int = 0, most: int = 100) -> DataFrame:
    """Order by a whitelisted column, ties by id."""
    if column not in allowed or direction not in ("asc", "desc") or not 1 <= limit <= most or offset < 0:
        raise ValueError(f"not an allowed order or limit: {column} {direction} {limit}")
    c = F.col(column)
    return df.orderBy(c.asc() if direction == "asc" else c.desc(), "id").offset(offset).limit(limit)


def order_clause(text: str, allowed: tuple[str, ...]) -> list[Column]:
    """'updated desc' as columns; names that are not allowed are an error, nothing is interpolated."""
    name, _, direction = text.strip().partition(" ")
    if name not in allowed or direction.strip().lower() not in ("", "asc", "desc"):
        raise ValueError(f"not an allowed order: {text}")
    return [F.col(name).desc() if direction.strip().lower() == "desc" else F.col(name).asc(), F.col("id")]


def page_count(df: DataFrame, limit: int) -> DataFrame:
    """total and pages (1 for no rows)."""
    return df.agg(F.count("*").alias("total")).select("total", F.greatest(F.ceil(F.col("total") / limit), F.lit(1)).cast("long").alias("pages"))


def register_summary(records: DataFrame) -> DataFrame:
    """One row; zeros for no records. Rooms drop null and empty ids, buildings only nulls."""
    risk = lambda x: F.count_if(F.col("risk_status") == x)
    return records.agg(
        F.count("*").alias("total_records"), risk("High").alias("high_risk_count"), risk("Medium").alias("medium_risk_count"), risk("Low").alias("low_risk_count"),
        F.count_distinct("building_id").alias("building_count"), F.count_distinct(F.nullif("room_id", F.lit(""))).alias("room_count"),
    )


def basic_stats(df: DataFrame, column: str) -> DataFrame:
    c = F.col(column)
    return df.agg(F.count(c).alias("count"), F.sum(c).alias("sum"), F.avg(c).alias("average"), F.min(c).alias("min"), F.max(c).alias("max"))


def types_by_provider(models: DataFrame, available: DataFrame | None = None) -> DataFrame:
    """provider and its sorted distinct model types, of the available providers (provider)."""
    x = models if available is None else models.join(available.select("provider"), "provider", "left_semi")
    return x.groupBy("provider").agg(F.array_join(F.sort_array(F.collect_set("type")), ",").alias("types"), F.count("*").alias("models"))


def status_message(status: Column) -> Column:
    """The texts for a job's state."""
    texts = {"completed": "Source processing completed successfully", "failed": "Source processing failed", "running": "Source processing in progress", "queued": "Source processing queued", "new": "Source processing queued"}
    out = None
    for k, v in texts.items():
        out = F.when(status == k, v) if out is None else out.when(status == k, v)
    return out.otherwise(F.concat(F.lit("Source processing status: "), F.coalesce(status, F.lit("unknown"))))


def available(path: Column, root: str, existing: DataFrame, base: DataFrame) -> DataFrame:
    """Adds file_available: null without a path, false outside root, else whether the path is among existing (column path)."""
    x = base.withColumn("__path", path)
    x = x.join(existing.select(F.col("path").alias("__there")).distinct(), F.col("__path") == F.col("__there"), "left")
    flag = F.when(F.col("__path").isNull(), F.lit(None).cast("boolean")).when(~F.startswith("__path", F.lit(root)), False).otherwise(F.col("__there").isNotNull())
    return x.withColumn("file_available", flag).drop("__path", "__there")


def scanned(df: DataFrame, required: tuple[str, ...] = (), order: list[Column] | None = None) -> DataFrame:
    """All rows whose required columns are not blank, in order; the others are skipped."""
    ok = reduce(lambda a, c: a & F.coalesce(F.trim(F.col(c).cast("string")) != "", F.lit(False)), required, F.lit(True))
    return df.where(ok).orderBy(*order) if order else df.where(ok)


def records(tables: dict[str, DataFrame], ids: DataFrame, columns: list[str]) -> DataFrame:
    """table and columns of the records that ids (column `id`, prefix:key) name; each table is asked for its own prefix.

    Ids of no table, or of no row, give nothing."""
    own = lambda name: ids.where(F.substring_index("id", ":", 1) == name).select("id").distinct()
    return reduce(DataFrame.unionByName, [df.join(own(name), "id", "left_semi").select(F.lit(name).alias("table"), *columns) for name, df in tables.items()])


def record(tables: dict[str, DataFrame], id: str) -> DataFrame:
    """The row with this id, from the table that its prefix names."""
    name = id.partition(":")[0]
    if name not in tables:
        raise ValueError(f"no table of {id}")
    return tables[name].where(F.col("id") == id)


def singleton(df: DataFrame, id: str, defaults: dict) -> DataFrame:
    """One row: the fields of the record with this id, and the default where it, or a field of it, is missing."""
    found = df.where(F.col("id") == id).limit(1).agg(*[F.first(c).alias(c) for c in defaults])  # one row, of nulls if there is none
    return found.select(F.lit(id).alias("id"), *[F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in defaults.items()])


def bound_query(spark: SparkSession, text: str, views: dict[str, DataFrame], **arguments) -> DataFrame:
    """A query over the views with named arguments (:name), which are bound and never put into its text."""
    return spark.sql(text, args=arguments, **views)


def by_field(df: DataFrame, path: str, direction: str, *more: str) -> DataFrame:
    """Order by a field inside a struct."""
    c = F.col(path)
    return df.orderBy(c.desc() if direction == "desc" else c.asc(), *more)


def scrolled(df: DataFrame, order: list, offset: int, limit: int = 30) -> DataFrame:
    """The next rows of a total order, and has_more: whether the page is full, so that there may be another."""
    x = df.orderBy(*order).offset(offset).limit(limit)
    return x.join(F.broadcast(x.agg((F.count("*") == limit).alias("has_more"))))  # one row


def with_profile(episodes: DataFrame, speakers: DataFrame) -> DataFrame:
    """Episode profiles with the speakers of the profile that speaker_config names; those that name none go."""
    return episodes.join(speakers.select(F.col("name").alias("speaker_config"), F.col("speakers")), "speaker_config")


def commands_by_app(commands: DataFrame) -> DataFrame:
    """app_id, its command names in order, and their number."""
    return commands.groupBy("app_id").agg(F.array_join(F.sort_array(F.collect_list("name")), ",").alias("names"), F.count("*").alias("commands"))


def listed_episodes(episodes: DataFrame, states: DataFrame) -> DataFrame:
    """Episodes that have a command or an audio file, with job_status: that of the command (unknown if it has none), or
    completed for an audio file alone. states: job_id, status."""
    has = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    x = episodes.where(has("command") | has("audio_file")).join(states.select(F.col("job_id").alias("__job"), F.col("status").alias("__status")), F.col("command") == F.col("__job"), "left")
    return x.withColumn("job_status", F.when(has("command"), F.coalesce("__status", F.lit("unknown"))).otherwise("completed")).drop("__job", "__status")


def latest(df: DataFrame, by: str, order: list[str]) -> DataFrame:
    """The last row of each `by` in the order, from partial maxima."""
    rest = [c for c in df.columns if c != by and c not in order]
    top = df.groupBy(by).agg(F.max(F.struct(*order, *rest)).alias("__last"))
    return top.select(*[F.col(by) if c == by else F.col(f"__last.{c}").alias(c) for c in df.columns])
