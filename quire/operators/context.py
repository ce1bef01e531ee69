"""Context for a question: items are deduplicated, ranked by priority and cut to a token budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cut, token_count, with_prefix
from .durable import checkpointed

#: Priority by type of item.
WEIGHTS = {"source": 100, "insight": 75, "note": 50}


def priority(type: Column) -> Column:
    out = None
    for k, v in WEIGHTS.items():
        out = F.when(type == k, v) if out is None else out.when(type == k, v)
    return out.otherwise(F.lit(0))


def level(setting: Column) -> Column:
    """skip, short or full, by the words of the setting; short where both are named."""
    return F.when(F.contains(setting, F.lit("not in")), "skip").when(F.contains(setting, F.lit("insights")), "short").when(F.contains(setting, F.lit("full content")), "full").otherwise("skip")


def deduplicated(items: DataFrame) -> DataFrame:
    """The first item of each id by position."""
    return items.withColumn("__n", F.row_number().over(Window.partitionBy("id").orderBy("position"))).where("__n = 1").drop("__n")


def running_total(rows: DataFrame, group: list[str], order: list[Column], value: str, out: str) -> DataFrame:
    """Adds the running total of `value` in a total order inside each group.

    Rows are range-partitioned, partitions are summed, and rows add up inside their partition from there on: no task gets
    a group whole. Which rows a partition holds is written out first, so a task that runs again finds the same."""
    keys = [F.col(f"`{g}`") for g in group]
    x = checkpointed(rows.repartitionByRange(*keys, *order).withColumn("__part", F.spark_partition_id()))
    sums = x.groupBy(*group, "__part").agg(F.sum(value).alias("__sum"))  # groups and partitions, not their product
    before = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*group, "__part", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy(*group, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    on = [F.col(f"x.`{c}`").eqNullSafe(F.col(f"s.`{c}`")) for c in [*group, "__part"]]
    joined = x.alias("x").join(starts.alias("s"), on).select("x.*", "s.__start")
    return joined.withColumn(out, F.col("__start") + F.sum(value).over(inside)).drop("__start", "__part")


def assemble(items: DataFrame, max_tokens: int | None = None, by: str | None = None) -> DataFrame:
    """items: id, type, content, priority, tokens, position (and `by`, if contexts of many notebooks are made at once).

    Adds `upto`, the tokens so far; with a budget (0 or None: none), items are those whose running total stays within it.
    Totals are made of ids and numbers alone; content is joined to what is left."""
    keys = [by] if by else []
    first = F.row_number().over(Window.partitionBy(*keys, "id").orderBy("position"))
    narrow = items.select(*keys, "id", "position", "priority", "tokens").withColumn("__n", first).where("__n = 1").drop("__n")
    x = running_total(narrow, keys, [F.col("priority").desc(), F.col("position")], "tokens", "upto")
    x = x.where(F.col("upto") <= max_tokens) if max_tokens else x
    chosen = x.select(*[F.col(c).alias(f"__{c}") for c in [*keys, "id", "position"]], "upto")
    on = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in [*keys, "id", "position"]]
    return items.dropDuplicates([*keys, "id", "position"]).join(chosen, on).select(*items.columns, "upto")


def notebook_items(reference: DataFrame, source: DataFrame, insight: DataFrame, note: DataFrame, sources_at: str = "insights", notes_at: str = "full content") -> DataFrame:
    """notebook, id, type, content, priority, tokens, position of every notebook's items at the given levels."""

    def items(df: DataFrame, type: str, content: Column, place: Column) -> DataFrame:
        x = df.select("notebook", "id", F.lit(type).alias("type"), content.alias("content"), priority(F.lit(type)).alias("priority"), place.alias("position"))
        return x.withColumn("tokens", token_count(F.col("content")))

    parts = []
    edges = reference.select(F.col("in").alias("source"), F.col("out").alias("notebook"))
    s = edges.join(source.withColumnRenamed("id", "source"), "source").withColumn("id", F.col("source"))
    if level_of(sources_at) != "skip":
        text = F.concat_ws("\n", "title", "full_text") if level_of(sources_at) == "full" else F.col("title")
        parts.append(items(s, "source", text, F.struct(F.lit(0).alias("k"), F.col("id").alias("id"))))
    if level_of(sources_at) == "short":
        i = edges.join(insight, "source")
        parts.append(items(i, "insight", F.concat_ws(": ", "insight_type", "content"), F.struct(F.lit(1).alias("k"), F.col("id").alias("id"))))
    if level_of(notes_at) != "skip":
        text = F.concat_ws("\n", "title", "content") if level_of(notes_at) == "full" else F.concat_ws("\n", "title", F.substring("content", 1, 100))
        parts.append(items(note, "note", text, F.struct(F.lit(2).alias("k"), F.col("id").alias("id"))))
    if not parts:
        raise ValueError("no level takes anything in")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def level_of(setting: str) -> str:
    """level() for one setting."""
    return "skip" if "not in" in setting else "short" if "insights" in setting else "full" if "full content" in setting else "skip"


def response(items: DataFrame, by: str = "notebook") -> DataFrame:
    """Counts by type and totals of each context."""
    kind = lambda t: F.count_if(F.col("type") == t)
    return items.groupBy(by).agg(kind("source").alias("sources"), kind("insight").alias("insights"), kind("note").alias("notes"), F.count("*").alias("total_items"), F.sum("tokens").alias("total_tokens"))


def selected(config: DataFrame, items: DataFrame, table: str) -> DataFrame:
    """Items named by config (id with or without prefix, setting) with their level; skipped and missing ones go."""
    x = config.select(with_prefix(F.col("id"), table).alias("id"), level(F.col("setting")).alias("level"))
    return x.where("level <> 'skip'").join(items, "id")


def insights_of(insight: DataFrame) -> DataFrame:
    """source and its insights (array of id, insight_type, content), in order of id."""
    return insight.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("id", "insight_type", "content"))).alias("insights"))


def source_contexts(source: DataFrame, insight: DataFrame, size: str = "short") -> DataFrame:
    """id and context: a JSON text of id, title, insights, and with size long the full text. Null fields are left out."""
    x = source.join(insights_of(insight).withColumnRenamed("source", "__s"), F.col("id") == F.col("__s"), "left")
    insights = F.coalesce("insights", F.array().cast("array<struct<id:string,insight_type:string,content:string>>")).alias("insights")
    return x.select("id", F.to_json(F.struct("id", "title", insights, *(["full_text"] if size == "long" else []))).alias("context"))


def note_contexts(note: DataFrame, size: str = "short") -> DataFrame:
    """id and context: a JSON text of id, title and content, with size short its first 100 characters."""
    content = F.col("content") if size == "long" else F.substring("content", 1, 100)
    return note.select("id", F.to_json(F.struct("id", "title", content.alias("content"))).alias("context"))


def endpoint_context(config: DataFrame | None, source: DataFrame, insight: DataFrame, note: DataFrame, reference: DataFrame | None = None, notebook: str | None = None) -> DataFrame:
    """type, id, context of what a request takes in.

    config: type (source or note), id with or without prefix, setting. For sources `insights` wins over `full content`;
    notes come in with `full content` alone; ids that name nothing are skipped. Without config, all of the notebook, short."""
    named = lambda x, kind: x.select(F.lit(kind).alias("type"), "id", "context")
    if config is None:
        s = source.join(reference.where(F.col("out") == notebook).select(F.col("in").alias("id")), "id", "left_semi")
        return named(source_contexts(s, insight), "source").unionByName(named(note_contexts(note.where(F.col("notebook") == notebook)), "note"))
    c = config.select("type", with_prefix(F.col("id"), F.col("type")).alias("id"), level(F.col("setting")).alias("level")).where("level <> 'skip'").distinct()
    ids = lambda kind, size: c.where((F.col("type") == kind) & (F.col("level") == size)).select("id")
    parts = [named(source_contexts(source.join(ids("source", size), "id", "left_semi"), insight, long), "source") for size, long in (("short", "short"), ("full", "long"))]
    parts.append(named(note_contexts(note.join(ids("note", "full"), "id", "left_semi"), "long"), "note"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def context_totals(contexts: DataFrame) -> DataFrame:
    """sources, notes, token_count and char_count of all contexts together; words do not run on from one to the next."""
    kind = lambda t: F.count_if(F.col("type") == t)
    words = F.coalesce(F.sum(F.regexp_count("context", F.lit(r"\S+"))), F.lit(0))
    return contexts.agg(kind("source").alias("sources"), kind("note").alias("notes"), F.floor(words * F.lit(1.3).cast("double")).cast("long").alias("token_count"), F.coalesce(F.sum(F.length("context")), F.lit(0)).alias("char_count"))


def source_items(source_id: str, source: DataFrame, insight: DataFrame) -> DataFrame:
    """Items of one source with its insights, as notebook_items() has them."""
    edge = source.where(F.col("id") == source_id).select(F.col("id").alias("in"), F.lit(source_id).alias("out"))
    return notebook_items(edge, source, insight, source.limit(0).select(F.lit("").alias("notebook"), "id", "title", F.lit("").alias("content")))


def mixed_items(source_ids: list[str], note_ids: list[str], notebook: str | None, reference: DataFrame, source: DataFrame, insight: DataFrame, note: DataFrame) -> DataFrame:
    """The named sources and notes of one notebook; nothing without a notebook, as in the behaviour that is rebuilt."""
    edges = reference.where((F.col("out") == notebook) & F.col("in").isin(source_ids)) if notebook else reference.limit(0)
    notes = note.where((F.col("notebook") == notebook) & F.col("id").isin(note_ids)) if notebook else note.limit(0)
    return notebook_items(edges, source, insight, notes)


def source_prompt(source: DataFrame, insight: DataFrame, total_tokens: Column) -> DataFrame:
    """id and prompt: the text about one source that a chat is given. Its headings and marks."""
    x = source.join(insights_of(insight).withColumnRenamed("source", "__s"), F.col("id") == F.col("__s"), "left")
    none = F.array().cast("array<struct<id:string,insight_type:string,content:string>>")
    insights = F.coalesce("insights", none)
    lit = F.lit
    content = F.when(F.coalesce("full_text", lit("")) != "", F.concat(lit("**Content:**\n"), cut(F.col("full_text")), lit("\n")))
    head = F.concat(lit("## SOURCE CONTENT\n**Source ID:** "), "id", lit("\n**Title:** "), F.coalesce("title", lit("No title")), lit("\n"), F.coalesce(content, lit("")), lit("\n"))
    one = lambda i: F.concat(lit("**Insight ID:** "), i["id"], lit("\n**Type:** "), F.coalesce(i["insight_type"], lit("Unknown")), lit("\n**Content:** "), F.coalesce(i["content"], lit("No content")), lit("\n\n"))
    middle = F.when(F.size(insights) > 0, F.concat(lit("## SOURCE INSIGHTS\n"), F.array_join(F.transform(insights, one), ""))).otherwise("")
    tail = F.concat(lit("## CONTEXT METADATA\n- Source count: 1\n- Insight count: "), F.size(insights).cast("string"), lit("\n- Total tokens: "), total_tokens.cast("string"), lit("\n"))
    return x.select("id", F.concat(head, middle, tail).alias("prompt"))
