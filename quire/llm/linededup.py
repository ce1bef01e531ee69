"""Line dedup: lines that many documents hold go, but for those of one document; in DataFrame functions alone.

Each text's lines are normalised and hashed where they are; exploded hashes are counted by distinct documents, and hashes over
the threshold are joined back to the places where they stand. A document's places of dropped lines, sorted, then part its
lines into the runs that stay, which are put together in their order. Only hashes and places are exploded and shuffled; a text
moves once, to meet its own places.

A line's key is the line without `[\\x20\\x09-\\x0D]` at both ends, A-Z in lower case; keys are told apart by 128 bits.
Documents are told apart by id: rows that share one count once, and a null id is one document, before all others; each row is
answered by itself, and rows that are equal alike. A null or empty text is one empty line. A key that one document repeats
counts once. A very long text is split and joined in one task; a hot line is added up in parts before it is shuffled, and
its places meet its verdict in a join that adaptive execution can split. An empty table gives an empty result. Other columns
may have any name; they are left aside.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import joined_back
from .durable import checkpointed

SPACES = " \t\n\v\f\r"


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else as it is; lower() is the faster way where no other letter can be met."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_keys(text: Column, min_chars: int) -> Column:
    """Each line's key, null where it is shorter than min_chars."""
    stripped = F.transform(lines_of(text), lambda x: F.btrim(x, F.lit(SPACES)))
    return F.transform(stripped, lambda x: F.when(F.length(x) >= min_chars, lower_ascii(x)))


def _row(salt: str) -> Column:
    """Half of what tells a row from others."""
    return F.xxhash64(F.lit(salt), F.col("doc_id").isNull(), "doc_id", F.coalesce("text", F.lit("")))


def hashed(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, the two halves r, s of what tells the row, and a struct (a, b), or null, for each line; written out."""
    x = docs.select("doc_id", _row("r").alias("r"), _row("s").alias("s"), line_keys(F.col("text"), min_chars).alias("keys"))
    pair = lambda k: F.when(k.isNotNull(), F.struct(F.xxhash64(F.lit("a"), k).alias("a"), F.xxhash64(F.lit("b"), k).alias("b")))
    return checkpointed(x.select("doc_id", "r", "s", F.transform("keys", pair).alias("lines")))


def common_lines(rows: DataFrame, min_docs: int) -> DataFrame:
    """line (a, b) and keeper, the largest id that holds it, of the lines that at least min_docs documents hold."""
    each = rows.select("doc_id", F.explode(F.array_distinct("lines")).alias("line")).where(F.col("line").isNotNull()).distinct()
    return each.groupBy("line").agg(F.count("*").alias("docs"), F.max("doc_id").alias("keeper")).where(F.col("docs") >= min_docs).select("line", "keeper")


def dropped_places(rows: DataFrame, common: DataFrame) -> DataFrame:
    """r, s and the sorted places of the lines that go, for rows that lose any."""
    each = rows.select("doc_id", "r", "s", F.posexplode("lines").alias("place", "line")).where(F.col("line").isNotNull())
    met = joined_back(each, common, "line").where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    return met.groupBy("r", "s").agg(F.array_sort(F.collect_set("place")).alias("places"))


def _without(lines: Column, places: Column) -> Column:
    """Lines, but for those at the sorted places: the runs between them."""
    start = lambda i: F.when(i == 0, 0).otherwise(F.get(places, i - 1) + 1)
    end = lambda i: F.coalesce(F.get(places, i), F.size(lines))
    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(places)), lambda i: F.slice(lines, start(i) + 1, end(i) - start(i))))


def without_common_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """doc_id, n_lines (before dropping), n_dropped, kept_text of each row.

    Lines whose key has at least min_chars code points and is found in at least min_docs (2 or more) documents stay only in the
    largest doc_id that holds it."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = hashed(docs, min_chars)
    places = dropped_places(rows, common_lines(rows, min_docs))
    x = docs.withColumns({"r": _row("r"), "s": _row("s")}).join(checkpointed(places), ["r", "s"], "left")
    x = x.select("doc_id", "text", "places", lines_of(F.col("text")).alias("lines"))
    kept = F.when(F.col("places").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(_without(F.col("lines"), F.col("places")), "\n"))
    return x.select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept_text"))


ORACLE_SQL = """
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
each AS (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS place FROM split),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM each),
common AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
judged AS (SELECT k.*, c.keeper IS NOT NULL AND c.keeper <> k.doc_id AS dropped FROM keyed k LEFT JOIN common c USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count_if(dropped)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
