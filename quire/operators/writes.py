"""Write operators as plans: what a table holds after an insert, merge or delete. The caller writes the result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def inserted(table: DataFrame, rows: DataFrame, now: Column | None = None) -> DataFrame:
    now = F.current_timestamp() if now is None else now
    return table.unionByName(rows.drop("created", "updated").withColumns({"created": now, "updated": now}), allowMissingColumns=True)


def insert_batch(table: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """All of rows, or none if one of them is there already."""
    taken = rows.join(table.select(key), key, "left_semi").agg(F.count("*").alias("__taken"))
    return table.unionByName(rows.join(F.broadcast(taken)).where("__taken = 0").drop("__taken"), allowMissingColumns=True)


def merged(table: DataFrame, patch: DataFrame, key: str = "id", insert: bool = False) -> DataFrame:
    """Fields that the patch gives (not null) replace the table's; with insert, new keys come in. One patch a key."""
    fields = [c for c in patch.columns if c != key]
    p = patch.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__new_{c}") for c in fields])
    x = table.join(p, F.col(key) == F.col("__key"), "full_outer" if insert else "left")
    out = [F.coalesce(key, "__key").alias(key) if c == key else F.coalesce(f"__new_{c}", c).alias(c) if c in fields else F.col(c) for c in table.columns]
    return x.select(*out)


def without(table: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows whose key is not among keys (column `key`); rows with a null key stay."""
    return table.join(keys.select(F.col("key").alias("__key")), F.col(on) == F.col("__key"), "left_anti")


def deleted_count(table: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    return table.join(keys.select(F.col("key").alias("__key")).distinct(), F.col(on) == F.col("__key"), "left_semi").agg(F.count("*").alias("deleted"))


def cascade(children: dict[str, tuple[DataFrame, str]], keys: DataFrame) -> dict[str, DataFrame]:
    """What each child table holds once its parents are gone."""
    return {name: without(df, keys, on) for name, (df, on) in children.items()}


def replaced(table: DataFrame, new: DataFrame, on: str) -> DataFrame:
    """The table with new rows in the place of all that has one of their keys: doing it twice is doing it once."""
    return without(table, new.select(F.col(on).alias("key")).distinct(), on).unionByName(new, allowMissingColumns=True)


def saved_as_notes(notes: DataFrame, edges: DataFrame, insights: DataFrame, notebook: str) -> tuple[DataFrame, DataFrame]:
    """notes and edges with a note for each insight (id, insight_type, source_title, content), linked to the notebook."""
    made = insights.select(F.concat(F.lit("note:"), F.replace("id", F.lit(":"), F.lit("-"))).alias("id"), F.concat("insight_type", F.lit(" from source "), "source_title").alias("title"), "content", F.lit("ai").alias("note_type"))
    return notes.select("id", "title", "content", "note_type").unionByName(made), linked_once(edges, made.select(F.col("id").alias("in"), F.lit(notebook).alias("out")))


def linked_once(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Edges and those of new that are not there yet."""
    fresh = new.select("in", "out").distinct().join(edges.select("in", "out"), ["in", "out"], "left_anti")
    return edges.select("in", "out").unionByName(fresh)


def unlinked(edges: DataFrame, gone: DataFrame) -> DataFrame:
    return edges.join(gone.select("in", "out"), ["in", "out"], "left_anti")


def free_names(taken: DataFrame, new: DataFrame, order: str | None = None) -> DataFrame:
    """Adds `free_name` to new (file_name): the name itself, or `stem (n).ext` with the first number that is free.

    Of new rows with one name the first takes it if nobody has it; names that are taken as they are count as taken for the
    numbered ones, so no two rows get one name. The extension begins at the last dot, if that is not the first character.
    First is the smallest by the column `order`; without one, rows of one name are first as they come to be read."""
    split = r"^(.+)(\.[^.]+)$"
    stem = lambda c: F.coalesce(F.nullif(F.regexp_extract(c, split, 1), F.lit("")), c)
    first = Window.partitionBy("file_name").orderBy(F.col(order) if order else F.monotonically_increasing_id())
    x = new.withColumn("__nth", F.row_number().over(first))
    have = taken.select(F.col("file_name").alias("__have")).distinct()
    x = x.join(have, F.col("file_name") == F.col("__have"), "left")
    x = x.withColumn("__as_is", (F.col("__nth") == 1) & F.col("__have").isNull())
    # how many of a name need numbers: all of its rows, but for one that keeps the name
    asked = x.groupBy("file_name").agg(F.count_if(~F.col("__as_is")).alias("__asked")).where("__asked > 0").withColumnRenamed("file_name", "__name")
    used = have.unionByName(x.where("__as_is").select(F.col("file_name").alias("__have")))
    numbered = r"^(.*) \(([1-9]\d{0,17})\)(\.[^.]+)?$"
    used = used.where(F.regexp_like("__have", F.lit(numbered))).select(F.concat(F.regexp_extract("__have", numbered, 1), F.regexp_extract("__have", numbered, 3)).alias("__name"), F.regexp_extract("__have", numbered, 2).cast("long").alias("__n"))
    used = used.join(asked.select("__name"), "__name", "left_semi").distinct()
    spent = asked.join(used.groupBy("__name").agg(F.count("*").alias("__used")), "__name", "left")
    free = spent.select("__name", "__asked", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__asked") + F.coalesce("__used", F.lit(0)))).alias("__n")).join(used, ["__name", "__n"], "left_anti")
    free = free.withColumn("__place", F.row_number().over(Window.partitionBy("__name").orderBy("__n"))).where("__place <= __asked").select("__name", "__n", "__place")
    place = F.when(~F.col("__as_is"), F.row_number().over(Window.partitionBy("file_name", "__as_is").orderBy("__nth")))
    x = x.withColumn("__want", place)
    x = x.join(free, (F.col("file_name") == F.col("__name")) & (F.col("__want") == F.col("__place")), "left")
    ext = F.regexp_extract("file_name", split, 2)
    name = F.when(F.col("__as_is"), F.col("file_name")).otherwise(F.concat(stem(F.col("file_name")), F.lit(" ("), F.col("__n").cast("string"), F.lit(")"), ext))
    return x.select(*[F.col(f"`{c}`") for c in new.columns], name.alias("free_name"))


def cloned(table: DataFrame, key: str, copies: DataFrame, name: str = "name", mark: str = " - Copy") -> DataFrame:
    """Rows of the table whose `key` is among copies (columns key, new_key), under the new key and with the name marked."""
    x = table.join(copies.select(F.col("key").alias("__key"), F.col("new_key").alias("__new")), F.col(key) == F.col("__key"))
    return x.select(*[F.col("__new").alias(c) if c == key else F.concat(F.col(c), F.lit(mark)).alias(c) if c == name else F.col(c) for c in table.columns])


def seeded(table: DataFrame, seed: DataFrame, key: str = "id") -> DataFrame:
    """The table with the seed's rows that it has no key of yet; what is there stays as it is."""
    return table.unionByName(seed.join(table.select(key), key, "left_anti"), allowMissingColumns=True)
