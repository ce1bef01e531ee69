"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions alone.

Each source's documents stand in a queue in an order that a hash of their id shuffles; a source whose target is more
than its size sends its queue again, up to `most_times`. The virtual finish time of a document is the words its source
has sent when it ends, divided by the source's target. Over all sources documents are sent in order of finish time
until the total budget is used up, so each source has sent its target to within one document.

Running totals over a source of any size are made in two steps: buckets of the shuffle hash (or of virtual time), some
thousand rows each, are summed and the sums of the buckets added up; then rows add up inside their bucket. No task
gets all rows of a source.

Sizes: number of `[^\\x20\\x09-\\x0D]+` in the text, 0 for null. A null source is a source, the last one. Rows with
equal id are shuffled by their size after that; for `plan_mix`, rows that are equal in id and size are alike, and which
of them is sent first makes no difference; `mixed` tells them apart by source and text too. A very long text is one row of
its size, and only `mixed` moves it. Sources without words have target 0. An empty table gives an empty result. Other
columns are kept in `mixed`, left aside in `plan_mix`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .durable import checkpointed

#: Rows that a bucket holds about, and bits of the shuffle hash.
BUCKET_ROWS, KEY_BITS = 4096, 60


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def shuffle_key(id_col: Column, seed: str) -> Column:
    """The first 60 bits of the MD5 of seed:id."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("null")))), 1, KEY_BITS // 4), 16, 10).cast("long")


def _before(df: DataFrame, order: list[Column], **values: str) -> DataFrame:
    """Adds the sums of the named columns over all rows before a row, in a total order.

    Rows are range-partitioned and partitions summed, so no task gets all of them; which rows a partition holds is written
    out first. The window without a partition runs over partitions, not rows."""
    x = checkpointed(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    upto = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = x.groupBy("__part").agg(*[F.sum(c).alias(n) for n, c in values.items()])
    starts = sums.select("__part", *[F.coalesce(F.sum(n).over(upto), F.lit(0)).alias(f"__{n}") for n in values])
    inside = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    x = x.join(F.broadcast(starts), "__part")
    return x.withColumns({n: F.col(f"__{n}") + F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in values.items()}).drop("__part", *[f"__{n}" for n in values])


def source_targets(sizes: DataFrame, weights: Sequence[int], most_times: int) -> DataFrame:
    """One row for each source: sid (its rank, nulls last), rows, source_size, target.

    Targets are the level at which weights times the level, and no more than most_times the size, use up the total.
    Sources may be as many as documents."""
    by_source = sizes.groupBy("source").agg(F.count("*").alias("rows"), F.sum("size").alias("source_size")).withColumn("one", F.lit(1).cast("long"))
    ranked = _before(by_source, [F.col("source").asc_nulls_last()], rank="one").withColumn("sid", F.col("rank") + 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("long")
    x = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most_times)
    x = _before(x.withColumn("ratio", F.col("cap") / F.col("weight")), [F.col("ratio"), F.col("sid")], caps="cap", weights="weight")
    totals = x.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("all_weights"))
    x = x.join(F.broadcast(totals)).withColumn("level", (F.col("words") - F.col("caps")) / (F.col("all_weights") - F.col("weights")))
    x = x.join(F.broadcast(x.agg(F.max("level").alias("final"))))
    target = F.when(F.col("ratio") <= F.col("level"), F.col("cap").cast("double")).otherwise(F.least(F.col("weight") * F.col("final"), F.col("cap").cast("double")))
    return x.select("source", "sid", "rows", "source_size", target.alias("target"))


def running(df: DataFrame, group: list[str], bucket: str, order: list[str], value: str, out: str) -> DataFrame:
    """Adds the running total of `value` in `order` inside each group; buckets are ordered as their rows are."""
    sums = df.groupBy(*group, bucket).agg(F.sum(value).alias("__sum"))
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*group, bucket, F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.join(starts, [*group, bucket]).withColumn(out, F.col("__start") + F.sum(value).over(inside)).drop("__start")


def plan_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = (1, 2, 3), most_times: int = 3, seed: str = "mix") -> DataFrame:
    """doc_id, size, source_size, target, taken (words sent, repeats counted) of each row."""
    return _planned(docs, id_col, text_col, source_col, weights, most_times, seed, [])


def _planned(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: Sequence[int], most_times: int, seed: str, more: list[Column]) -> DataFrame:
    """plan_mix() with further columns, numbers by which rows of one id and size are told apart and put in order."""
    extra = [f"more{k}" for k in range(len(more))]
    sized = checkpointed(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words_in(F.col(text_col)).alias("size"), *[c.alias(n) for c, n in zip(more, extra, strict=True)]))
    targets = checkpointed(source_targets(sized, weights, most_times))
    total = targets.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("words"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows")).first()
    bits = F.least(F.greatest(F.ceil(F.log2(F.col("rows") / BUCKET_ROWS)), F.lit(0)), F.lit(40)).cast("int")
    joined = sized.join(targets.withColumn("bits", bits), sized["source"].eqNullSafe(targets["source"]))
    keyed = joined.select("doc_id", "size", *extra, "sid", "source_size", "target", "bits", shuffle_key(F.col("doc_id"), seed).alias("key")).withColumn("bucket", F.expr(f"shiftright(key, {KEY_BITS} - bits)"))
    queue = checkpointed(running(keyed, ["sid"], "bucket", ["key", "doc_id", "size", *extra], "size", "sent").drop("bucket", "bits"))
    times = [F.when(F.col("target") > 0, (F.col("sent") + n * F.col("source_size")) / F.col("target")) for n in range(most_times)]
    cut = _cut(queue, times, total.words, total.rows, extra)
    last = [F.coalesce(cut(t), F.lit(False)) for t in times]
    return queue.select("doc_id", *extra, "size", "source_size", "target", (F.col("size") * sum(x.cast("long") for x in last)).alias("taken"))


def _cut(queue: DataFrame, times: list[Column], words: int, rows: int, extra: list[str]):
    """Which finish times are sent before the budget is used up: a function of such a column.

    The budget ends in one bucket of virtual time; only that bucket's rows are put in order."""
    parts = max(1, rows // BUCKET_ROWS)
    # a document that starts before time 1 is all that can be sent within the budget
    sent = queue.select("sid", "key", "doc_id", "size", *extra, F.explode(F.array(*times)).alias("time"), "target").where((F.col("size") > 0) & (F.col("time") - F.col("size") / F.col("target") < 1))
    sent = sent.withColumn("slot", F.floor(F.col("time") * parts).cast("long"))
    sums = sent.groupBy("slot").agg(F.sum("size").alias("words"))
    after = sums.select("slot", "words", F.sum("words").over(Window.orderBy("slot")).alias("upto"))
    end = after.where(F.col("upto") > words).orderBy("slot").limit(1).first()
    if end is None:
        return lambda time: (time - F.col("size") / F.col("target") < 1) & (F.col("size") > 0)
    order = ["time", "sid", "key", "doc_id", "size", *extra]
    inside = sent.where(F.col("slot") == end.slot).select(*order, F.sum("size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)).alias("upto"))
    last = inside.where(F.col("upto") <= words - (end.upto - end.words)).orderBy(*[F.col(c).desc() for c in order]).first()
    if last is None:  # the slot's first document is already too long
        return lambda time: (F.floor(time * parts) < end.slot) & (time - F.col("size") / F.col("target") < 1)

    def taken(time: Column) -> Column:
        here = F.struct(time.alias("time"), "sid", "key", F.col("doc_id").alias("doc_id"), "size", *extra)
        there = F.struct(*[F.lit(last[c]).cast(queue.schema[c].dataType if c != "time" else "double").alias(c) for c in order])
        return (here <= there) & (time - F.col("size") / F.col("target") < 1)

    return taken


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = (1, 2, 3), most_times: int = 3, seed: str = "mix") -> DataFrame:
    """The mix itself: each row of docs as many times as it is sent, all columns kept, whatever their names.

    Rows are known by id, size, source and text, the last two by a hash; of rows that are equal in all of these each is sent
    as often as the one that is sent most, as none can be told from another."""
    x = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    id_, text, source = (f"c{docs.columns.index(c)}" for c in (id_col, text_col, source_col))
    said = F.xxhash64(F.col(source).isNull(), F.col(source), F.col(text))
    plan = _planned(x, id_, text, source, weights, most_times, seed, [said]).where("taken > 0")
    times = plan.groupBy("doc_id", "size", "more0").agg(F.max(F.expr("taken div size")).alias("times"))
    sized = x.withColumn("said", said)
    out = sized.join(times, F.col(id_).eqNullSafe(F.col("doc_id")) & (F.col("said") == F.col("more0")) & (words_in(F.col(text)) == F.col("size")))
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select(*x.columns).toDF(*docs.columns)


ORACLE_SQL = """
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
by_source AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM by_source),
weighted AS (SELECT *, (1 + (sid - 1) % 3)::BIGINT AS weight, 3 * source_size AS cap FROM ranked),
levels AS (
  SELECT *, cap::DOUBLE / weight::DOUBLE AS ratio,
    (sum(source_size) OVER () - coalesce(sum(cap) OVER w, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0))::DOUBLE AS level
  FROM weighted WINDOW w AS (ORDER BY cap::DOUBLE / weight::DOUBLE, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, sid, source_size,
    CASE WHEN ratio <= level THEN cap::DOUBLE ELSE least(weight * max(level) OVER (), cap::DOUBLE) END AS target FROM levels),
queue AS (
  SELECT d.doc_id, d.size, t.sid, t.source_size, t.target, ('0x' || substr(md5('mix:' || d.doc_id::VARCHAR), 1, 15))::BIGINT AS key
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
sent AS (SELECT *, sum(size) OVER (PARTITION BY sid ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS sent FROM queue),
copies AS (
  SELECT *, (sent + n * source_size)::DOUBLE / target AS time FROM sent, (SELECT unnest([0, 1, 2]) AS n) WHERE size > 0),
ordered AS (
  SELECT *, sum(size) OVER (ORDER BY time, sid, key, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto FROM copies
  WHERE time - size::DOUBLE / target < 1),
taken AS (
  SELECT doc_id, sum(size)::BIGINT AS taken FROM ordered WHERE upto <= (SELECT sum(size) FROM sized) GROUP BY doc_id)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(k.taken, 0)::BIGINT AS taken FROM queue q LEFT JOIN taken k USING (doc_id)
"""
