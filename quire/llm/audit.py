"""Filter interaction audit: what each filter of a chain removes, in every order that the filters can have.

Each document gets a mask of the filters that it fails, and documents are counted by (part, mask): 32 counts a part, from which
all orders and steps follow without another look at a document.

Duplicates are found by partition refinement: documents are split by their length in code points, then by hashes of
successive blocks (64 code points, up to 4096, the rest), and a document that is alone is dropped in each round. Texts that are
still together are compared whole: copies meet as one before they are shuffled. Where all texts of a class are one, its smallest
id is the original; a class that the hashes have thrown together (none is expected) is taken apart by text.

Words: runs of `[^\\x20\\x09-\\x0D]`, with case. A null text is an empty one, and all empty texts are identical. A null id
is larger than all others: it is a copy if a row with an id has its text, and rows that are equal in id and text are no copies
of each other. A null part is an empty text. A document with several labels has what any of them says; labels with a null id
are left aside. A very long text is taken whole in one task. An empty table gives an empty result. Other columns may have any
name; they are left aside.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import joined_back
from .durable import checkpointed

LETTERS = "ABCDE"
#: Ends of the blocks, in code points; the last block is the rest.
BLOCK_ENDS = (64, 4096)
CLASS = ["length", *[f"block{i}" for i in range(len(BLOCK_ENDS) + 1)]]


def failures(text: Column) -> Column:
    """Bits of the filters A to D that a text (not null) fails."""
    words = F.regexp_extract_all(text, F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))
    capitals = F.regexp_count(text, F.lit("[A-Z]"))
    # both sizes from one array of words
    counts = F.transform(F.array(words), lambda w: F.struct(F.size(w).cast("long").alias("n"), F.size(F.array_distinct(w)).cast("long").alias("d")))[0]
    few = F.transform(F.array(counts), lambda c: F.when(c["n"] < 50, 1).otherwise(0) + F.when(100 * c["d"] < 65 * c["n"], 2).otherwise(0))[0]
    return few + F.when(100 * capitals.cast("long") > 5 * F.length(text), 4).otherwise(0) + F.when(text.rlike("[#$%&*|]"), 8).otherwise(0)


def block_hash(text: Column) -> Column:
    return F.xxhash64(text)


def classed(text: Column) -> list[Column]:
    """Length and block hashes of a text."""
    starts = [0, *BLOCK_ENDS]
    sizes = [end - start for start, end in zip(starts, BLOCK_ENDS, strict=False)] + [2**31 - 1 - starts[-1]]
    return [F.length(text).alias("length"), *[block_hash(F.substring(text, s + 1, n)).alias(f"block{i}") for i, (s, n) in enumerate(zip(starts, sizes, strict=True))]]


def refined(rows: DataFrame) -> DataFrame:
    """The classes (columns CLASS, and first, the smallest id, nulls last) that are left with two rows or more.

    Rows that agree in all of CLASS stay together in each round, so they are one row with a count from the start."""
    left = rows.groupBy(*CLASS).agg(F.count("*").alias("together"), F.min("doc_id").alias("first"))
    for depth in range(1, len(CLASS)):
        keys = CLASS[:depth]
        groups = left.groupBy(*keys).agg(F.sum("together").alias("all")).where("all > 1")
        left = joined_back(left, groups.select(*keys), keys)
    return checkpointed(left.where("together > 1").select(*CLASS, "first"))


def _copy(first: str) -> Column:
    return F.col(first).isNotNull() & ~F.col("doc_id").eqNullSafe(F.col(first))


def with_copies(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """rows (doc_id, part, bits, CLASS) with `copy`: whether a smaller id has the same text. docs: doc_id, part, text (not null)."""
    classes = refined(rows)
    texts = joined_back(docs.select("doc_id", "text", *classed(F.col("text"))), classes.select(*CLASS), CLASS)
    whole = checkpointed(texts.groupBy(*CLASS, "text").agg(F.min("doc_id").alias("first")).select(*CLASS, F.sha2("text", 256).alias("digest"), "first"))
    kinds = checkpointed(whole.groupBy(*CLASS).agg(F.count("*").alias("kinds"), F.min("first").alias("first")))
    x = rows.join(kinds, CLASS, "left")
    one = x.where(F.coalesce("kinds", F.lit(1)) == 1).select("doc_id", "part", "bits", _copy("first").alias("copy"))
    if kinds.where("kinds > 1").isEmpty():
        return one
    mixed = joined_back(docs.select("doc_id", "part", "text", *classed(F.col("text"))), kinds.where("kinds > 1").select(*CLASS), CLASS)
    apart = mixed.select("doc_id", "part", failures(F.col("text")).alias("bits"), F.sha2("text", 256).alias("digest"), *CLASS).join(whole, [*CLASS, "digest"])
    return one.unionByName(apart.select("doc_id", "part", "bits", _copy("first").alias("copy")))


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, bits, n, good, toxic: documents by the filters that they fail. docs: doc_id, part, text."""
    docs = docs.select("doc_id", F.coalesce(F.col("part").cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    rows = checkpointed(docs.select("doc_id", "part", failures(F.col("text")).alias("bits"), *classed(F.col("text"))))
    said = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    x = with_copies(docs, rows).join(checkpointed(said), "doc_id", "left")
    total = lambda c: F.sum(F.coalesce(c, F.lit(0)).cast("long")).alias(c)
    return x.groupBy("part", (F.col("bits") + F.when(F.col("copy"), 16).otherwise(0)).alias("bits")).agg(F.count("*").alias("n"), total("good"), total("toxic"))


def _steps() -> Column:
    """The (filter, filters before it) that occur, 80 of them, each with the orders and steps where it does."""
    found: dict[tuple[int, int], list[tuple[str, int]]] = {}
    for order in permutations(LETTERS):
        before = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << LETTERS.index(letter)
            found.setdefault((bit, before), []).append(("".join(order), step))
            before |= bit
    place = lambda o, s: F.struct(F.lit(o).alias("filter_order"), F.lit(s).alias("step"))
    return F.array(*[F.struct(F.lit(bit).alias("bit"), F.lit(before).alias("before"), F.array(*[place(o, s) for o, s in at]).alias("places")) for (bit, before), at in found.items()])


def audited(counts: DataFrame) -> DataFrame:
    """The audit's rows from the counts of mask_counts(): at most 32 a part are gathered."""
    masks = counts.groupBy("part").agg(F.collect_list(F.struct("bits", "n", "good", "toxic")).alias("masks"))
    x = masks.select("part", "masks", F.explode(_steps()).alias("s")).select("part", "masks", "s.bit", "s.before", "s.places")
    bit, before = F.col("bit"), F.col("before")
    fails = lambda m, f: m["bits"].bitwiseAND(f) != 0

    def total(which, value: str = "n", weight=None) -> Column:
        return F.aggregate(F.filter("masks", which), F.lit(0).cast("long"), lambda s, m: s + m[value] * (weight(m) if weight else 1))

    here = lambda m: fails(m, bit) & ~fails(m, before)
    # of a document's failing filters each comes first in an equal share of the 120 orders
    share = lambda m: F.element_at(F.array(*[F.lit(120 // i) for i in range(1, 6)]), F.bit_count(m["bits"]))
    values = {
        "kept": total(lambda m: ~fails(m, bit) & ~fails(m, before)),
        "removed": total(here),
        "redundant": total(lambda m: fails(m, bit) & fails(m, before)),
        "unique_fails": total(lambda m: m["bits"] == bit),
        "good_lost": total(here, "good"),
        "toxic_lost": total(here, "toxic"),
        "shapley": total(lambda m: fails(m, bit), "n", share),
    }
    return x.select("part", "places", *[v.alias(n) for n, v in values.items()]).select("part", F.explode("places").alias("p"), *values).select("part", "p.filter_order", "p.step", *values)


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: 600 rows a part."""
    return audited(mask_counts(docs.select(F.col(id_col).alias("doc_id"), F.col(part_col).alias("part"), F.col(text_col).alias("text")), labels))


ORACLE_SQL = """
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
masks AS (
  SELECT t.part, coalesce(l.quality = 1, FALSE) AS good, coalesce(l.toxic = 1, FALSE) AS toxic,
    {'A': len(words) < 50, 'B': 100 * len(list_distinct(words)) < 65 * len(words),
     'C': 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 5 * length(text),
     'D': regexp_matches(text, '[#$%&*|]'), 'E': min(t.doc_id) OVER (PARTITION BY text) < t.doc_id} AS f
  FROM texts t LEFT JOIN labels l ON l.doc_id = t.doc_id),
flags AS (
  SELECT part, good, toxic, list_filter([CASE WHEN f.A THEN 'A' END, CASE WHEN f.B THEN 'B' END, CASE WHEN f.C THEN 'C' END, CASE WHEN f.D THEN 'D' END, CASE WHEN f.E THEN 'E' END], lambda x: x IS NOT NULL) AS failing FROM masks),
counted AS (SELECT part, failing, count(*) AS n, count_if(good) AS good, count_if(toxic) AS toxic FROM flags GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (
  SELECT filter_order, step::INTEGER AS step, filter_order[step] AS letter, string_split(filter_order[:step - 1], '') AS before
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
crossed AS (
  SELECT c.*, s.*, list_contains(failing, letter) AS fails, list_has_any(failing, before) AS gone FROM counted c, steps s),
result AS (
  SELECT part, filter_order, step, letter,
    coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (fails AND NOT gone), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (fails AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (failing = [letter]), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (fails AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (fails AND NOT gone), 0)::BIGINT AS toxic_lost
  FROM crossed GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM result
"""
