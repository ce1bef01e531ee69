"""BM25 search over stored postings: texts are tokenised once, a query reads the blocks of its own terms.

An index is a folder of Parquet tables that every machine sees, made of segments:

    docs      doc, field, id, parent, title, words     one row for each text, numbered by (field, length, id), in folders of ranges
    postings  field, term, block, n, most, shortest, offsets, counts, lengths     by bucket of the term, in order of term
    gone      segment, field, doc, words     texts of earlier segments that this one replaces or removes
    segments  field, docs, words, buckets, stemmed     written last: a segment that is not in here does not exist

A block holds a term's postings among BLOCK consecutive numbers, as offsets from its first number; `most` and `shortest` bound
what a text in it can score, whatever the statistics are later. Numbers follow lengths, so the texts of a block are about
equally long and the bounds are close. A hot term has many blocks and is spread over many files.

A query reads the bounds of its terms, scores the few blocks that promise most, and then only those blocks whose bound reaches
the score of the k-th text found there; ties stay. Results, and all statistics, are those of a scan of the texts that are
alive, whatever was added, replaced and removed, and in whichever segments they lie.

A text is known by (field, id), which is given once. Null texts and null ids are not indexed. Several fields, each with
statistics of its own, share an index.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stem import stem
from .durable import checkpointed
from .search import B, K1, insight_title, query_terms, tokens

#: Numbers that a block spans, and texts in the first blocks that are scored.
BLOCK, FIRST = 1024, 4
SCHEMAS = {
    "docs": "segment int, part int, doc long, field string, id string, parent string, title string, words int",
    "postings": "segment int, bucket int, field string, term string, block long, n int, most int, shortest int, offsets array<int>, counts array<int>, lengths array<int>",
    "gone": "by_segment int, segment int, field string, doc long, words int",
    "segments": "segment int, field string, docs long, words long, buckets int, stemmed boolean",
}


class Index:
    """The committed segments of an index folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        # one row for each segment and field
        self.segments = self._all("segments").collect() if self._exists("segments") else []
        self.numbers = sorted({s.segment for s in self.segments})
        self.buckets = self.segments[0].buckets if self.segments else 0
        self.stemmed = self.segments[0].stemmed if self.segments else False

    def _exists(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def _all(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.folder}/{name}")

    def table(self, name: str) -> DataFrame:
        """Rows of committed segments alone."""
        if not self.numbers or not self._exists(name):
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self._all(name).where(F.col("by_segment" if name == "gone" else "segment").isin(self.numbers))

    def terms(self, query: str) -> list[str]:
        terms = query_terms(query)
        return list(dict.fromkeys(map(stem, terms))) if self.stemmed else terms

    def postings(self, terms: list[str], fields: list[str] | None) -> DataFrame:
        """The terms' blocks: buckets are folders, terms are in order inside their files."""
        buckets = sorted({zlib.crc32(t.encode()) % self.buckets for t in terms}) if self.buckets else []
        x = self.table("postings").where(F.col("bucket").isin(buckets) & F.col("term").isin(terms))
        return x if fields is None else x.where(F.col("field").isin(fields))

    def alive(self) -> DataFrame:
        dead = self.table("gone").select("segment", "doc")
        return self.table("docs").join(dead, ["segment", "doc"], "left_anti")


def _write(df: DataFrame, folder: str, name: str, segment: int, by: str | None = None) -> None:
    writer = df.write.mode("overwrite")
    column = "by_segment" if name == "gone" else "segment"
    (writer.partitionBy(by) if by else writer).parquet(f"{folder}/{name}/{column}={segment}")


def _part(doc: str = "doc") -> Column:
    """The range that a number is from; ranges begin at multiples of BLOCK."""
    return F.expr(f"cast(shiftright({doc}, 33) AS int)").alias("part")


def _tallied(stemmed: bool):
    """mapInArrow function: of each text's words (the last column, t) how many there are, its distinct terms, joined by spaces,
    and how often it has each. A batch's distinct words are stemmed once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (batch.slice(i, 1024) for batch in batches for i in range(0, batch.num_rows, 1024)):
            lists = b.column("t")
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            coded = lists.flatten().dictionary_encode()
            words = coded.dictionary.to_pylist()
            term: dict[str, int] = {}
            of = np.array([term.setdefault(stem(w) if stemmed else w, len(term)) for w in words], dtype=np.int64)
            key, n = np.unique(np.repeat(np.arange(len(sizes)), sizes) << 32 | of[coded.indices.to_numpy()], return_counts=True)
            ends = np.searchsorted(key >> 32, np.arange(len(sizes) + 1)).astype(np.int32)
            names = pa.array(list(term), pa.string()).take(pa.array(key & 0xFFFFFFFF))
            joined = pc.binary_join(pa.ListArray.from_arrays(ends, names), " ")
            counts = pa.ListArray.from_arrays(ends, pa.array(n.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sizes.astype(np.int32)), joined, counts], [*b.schema.names[:-1], "words", "terms", "counts"])

    return run


def add(rows: DataFrame | None, folder: str, spark: SparkSession, removed: DataFrame | None = None, stemmed: bool = True, buckets: int = 64) -> int:
    """Writes a segment: rows (field, id, parent, title, text) are new or replace the text with their field and id; removed
    (field, id) go. Gives its number. A segment counts from when its row in `segments` is there; what an attempt that died
    before that has left is written over."""
    index = Index(spark, folder)
    number = index.numbers[-1] + 1 if index.numbers else 0
    if index.numbers:
        stemmed, buckets = index.stemmed, index.buckets
        keys = [df.select("field", "id") for df in (rows, removed) if df is not None]
        changed = reduce(DataFrame.unionByName, keys).distinct()
        _write(index.alive().join(changed, ["field", "id"], "left_semi").select("segment", "field", "doc", "words"), folder, "gone", number)
    if rows is None:
        rows = spark.createDataFrame([], "field string, id string, parent string, title string, text string")
    x = rows.where("text IS NOT NULL AND id IS NOT NULL").select("field", F.col("id").cast("string").alias("id"), F.col("parent").cast("string").alias("parent"), F.col("title").cast("string").alias("title"), tokens(F.col("text")).alias("t"))
    # the one pass over the texts: a row for each text with its terms, which stays whole until texts are in order
    counted = checkpointed(x.mapInArrow(_tallied(stemmed), "field string, id string, parent string, title string, words int, terms string, counts array<int>"))
    order = ["field", "words", "id"]
    docs = checkpointed(counted.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("doc", F.monotonically_increasing_id()))
    _write(docs.select("doc", "field", "id", "parent", "title", "words", _part()), folder, "docs", number, "part")

    # a block's texts stand in one partition, so its postings are together before anything is shuffled
    found = docs.where("terms <> ''").select("field", "doc", "words", F.expr(f"doc div {BLOCK}").alias("block"), F.explode(F.arrays_zip(F.split("terms", " ").alias("term"), "counts")).alias("e"))
    entry = F.struct((F.col("doc") - F.col("block") * BLOCK).cast("int").alias("o"), F.col("e.counts").alias("c"), F.col("words").alias("w"))
    blocks = found.groupBy("field", F.col("e.term").alias("term"), "block").agg(F.array_sort(F.collect_list(entry)).alias("p"))  # at most BLOCK
    part = lambda f: F.transform("p", lambda x: x[f])
    blocks = blocks.select("field", "term", "block", F.size("p").alias("n"), F.array_max(part("c")).alias("most"), F.array_min(part("w")).alias("shortest"), part("o").alias("offsets"), part("c").alias("counts"), part("w").alias("lengths"), (F.crc32("term") % buckets).cast("int").alias("bucket"))
    _write(blocks.repartitionByRange("bucket", "term", "field", "block").sortWithinPartitions("bucket", "term", "field", "block"), folder, "postings", number, "bucket")

    stats = docs.groupBy("field").agg(F.count("*").alias("docs"), F.sum("words").alias("words"))
    known = [s.field for s in stats.select("field").collect()]
    if not known:  # a segment that only removes has a row too
        stats = spark.createDataFrame([(None, 0, 0)], "field string, docs long, words long")
    _write(stats.select("field", "docs", "words", F.lit(buckets).alias("buckets"), F.lit(stemmed).alias("stemmed")).coalesce(1), folder, "segments", number)
    return number


def merged(folder: str, into: str, spark: SparkSession) -> None:
    """Writes an index of one segment with what is alive in another: no text is read again."""
    index = Index(spark, folder)
    docs = index.alive()
    order = ["field", "words", "id"]
    fresh = checkpointed(docs.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("new", F.monotonically_increasing_id()))
    _write(fresh.select(F.col("new").alias("doc"), "field", "id", "parent", "title", "words", _part("new")), into, "docs", 0, "part")
    entries = _entries(index.table("postings")).join(fresh.select("segment", "doc", "new"), ["segment", "doc"])
    entries = entries.withColumn("block", F.expr(f"new div {BLOCK}"))
    packed = F.struct((F.col("new") - F.col("block") * BLOCK).cast("int").alias("o"), F.col("count").alias("c"), F.col("words").alias("w"))
    blocks = entries.groupBy("bucket", "field", "term", "block").agg(F.array_sort(F.collect_list(packed)).alias("p"))
    part = lambda f: F.transform("p", lambda x: x[f])
    blocks = blocks.select("bucket", "field", "term", "block", F.size("p").alias("n"), F.array_max(part("c")).alias("most"), F.array_min(part("w")).alias("shortest"), part("o").alias("offsets"), part("c").alias("counts"), part("w").alias("lengths"))
    _write(blocks.repartitionByRange("bucket", "term", "field", "block").sortWithinPartitions("bucket", "term", "field", "block"), into, "postings", 0, "bucket")
    stats = fresh.groupBy("field").agg(F.count("*").alias("docs"), F.sum("words").alias("words"))
    _write(stats.select("field", "docs", "words", F.lit(index.buckets).alias("buckets"), F.lit(index.stemmed).alias("stemmed")).coalesce(1), into, "segments", 0)


def _entries(blocks: DataFrame) -> DataFrame:
    """A row for each posting: bucket, segment, field, term, block, doc, count, words."""
    each = F.explode(F.arrays_zip("offsets", "counts", "lengths")).alias("e")
    return blocks.select("bucket", "segment", "field", "term", "block", each).select("bucket", "segment", "field", "term", "block", (F.col("block") * BLOCK + F.col("e.offsets")).alias("doc"), F.col("e.counts").alias("count"), F.col("e.lengths").alias("words"))


def statistics(index: Index, terms: list[str], fields: list[str] | None) -> dict[str, tuple[int, float, dict[str, int]]]:
    """For each field: texts alive, their mean length, and how many hold each term. Blocks are opened only where a text is gone."""
    docs: dict[str, list[int]] = {}
    for s in index.segments:
        if s.field is not None and (fields is None or s.field in fields):
            n = docs.setdefault(s.field, [0, 0])
            n[0] += s.docs
            n[1] += s.words
    gone = index.table("gone")
    for g in gone.groupBy("field").agg(F.count("*").alias("docs"), F.sum("words").alias("words")).collect():  # a row a field
        if g.field in docs:
            docs[g.field][0] -= g.docs
            docs[g.field][1] -= g.words
    blocks = index.postings(terms, fields)
    holding = blocks.groupBy("field", "term").agg(F.sum("n").alias("n"))
    touched = gone.select("segment", "field", F.expr(f"doc div {BLOCK}").alias("block")).distinct()
    lost = _entries(blocks.join(touched, ["segment", "field", "block"], "left_semi")).join(gone.select("segment", "doc"), ["segment", "doc"], "left_semi").groupBy("field", "term").agg((-F.count("*")).alias("n"))
    have: dict[tuple[str, str], int] = {}
    for r in holding.unionByName(lost).groupBy("field", "term").agg(F.sum("n").alias("n")).collect():  # a row a field and term
        have[r.field, r.term] = r.n
    return {f: (n, words / n, {t: have.get((f, t), 0) for t in terms}) for f, (n, words) in docs.items() if n}


def _score(stats: dict, terms: list[str], count: Column, length: Column) -> Column:
    """One term's part of the score, for columns field and term; the larger the count and the shorter the text, the larger."""
    idf = F.create_map(*[F.lit(x) for f, (n, _, have) in stats.items() for t in terms for x in (f"{f} {t}", n - have[t] + 0.5)])
    low = F.create_map(*[F.lit(x) for f, (_, _, have) in stats.items() for t in terms for x in (f"{f} {t}", have[t] + 0.5)])
    mean = F.create_map(*[F.lit(x) for f, (_, mean, _) in stats.items() for x in (f, float(mean))])
    key = F.concat_ws(" ", "field", "term")
    norm = K1 * (1 - B + B * length / mean[F.col("field")])
    return F.ln(1 + idf[key] / low[key]) * count * (K1 + 1) / (count + norm)


def _hits(blocks: DataFrame, index: Index, stats: dict, terms: list[str]) -> DataFrame:
    """segment, field, doc, relevance of the texts alive that hold all terms; terms are added in their order, so that equal
    texts score equally on every plan."""
    x = _entries(blocks).withColumn("score", _score(stats, terms, F.col("count"), F.col("words")))
    x = x.groupBy("segment", "field", "doc").agg(F.count("*").alias("held"), F.map_from_entries(F.collect_list(F.struct("term", "score"))).alias("scores")).where(F.col("held") == len(terms))
    x = x.join(index.table("gone").select("segment", "doc"), ["segment", "doc"], "left_anti")
    return x.select("segment", "field", "doc", reduce(lambda a, b: a + b, [F.col("scores")[t] for t in terms]).alias("relevance"))


def _grouped(hits: DataFrame, blocks: DataFrame, index: Index) -> DataFrame:
    """field, id (what the text is found for, its parent), parent_id, title and best relevance; none without a parent.

    Of the texts only those ranges are read that the blocks are from: there are as many as the index has files."""
    ranges = blocks.select("segment", _part(f"block * {BLOCK}")).distinct().collect()
    docs = index.table("docs").where(F.col("segment").isin([r.segment for r in ranges]) & F.col("part").isin([r.part for r in ranges]))
    x = hits.join(docs.select("segment", "doc", "parent", "title"), ["segment", "doc"]).where("parent IS NOT NULL")
    return x.groupBy("field", F.col("parent").alias("id"), "title").agg(F.max("relevance").alias("relevance")).select("field", "id", F.col("id").alias("parent_id"), "title", "relevance")


def candidates(index: Index, query: str, k: int, fields: list[str] | None = None, statistics_of: dict | None = None) -> tuple[DataFrame, DataFrame | None, float]:
    """The bounds of the blocks where all terms occur (segment, field, block, bound), those whose bound can reach the k best,
    and the score that they must reach."""
    terms = index.terms(query)
    stats = statistics(index, terms, fields) if statistics_of is None else statistics_of
    blocks = index.postings(terms, fields)
    if not stats:
        return blocks.select("segment", "field", "block", F.lit(0.0).alias("bound")).limit(0), None, 0.0
    bound = _score(stats, terms, F.col("most"), F.col("shortest"))
    heads = blocks.select("segment", "field", "term", "block", bound.alias("bound"))
    heads = checkpointed(heads.groupBy("segment", "field", "block").agg(F.count("*").alias("held"), F.sum("bound").alias("bound")).where(F.col("held") == len(terms)).drop("held"))
    first = checkpointed(heads.orderBy(F.col("bound").desc(), "segment", "field", "block").limit(FIRST))
    best = _grouped(_hits(blocks.join(F.broadcast(first.drop("bound")), ["segment", "field", "block"], "left_semi"), index, stats, terms), first, index)
    # of one id in two fields the better counts, once
    kth = best.groupBy("id", "parent_id", "title").agg(F.max("relevance").alias("relevance")).orderBy(F.col("relevance").desc()).limit(k).agg(F.count("*").alias("n"), F.min("relevance").alias("low")).first()
    least = kth.low if kth.n == k else 0.0
    return heads, heads.where(F.col("bound") >= least * (1 - 1e-9)), least


def search(spark: SparkSession, folder: str, query: str, k: int, fields: list[str] | None = None) -> DataFrame:
    """id, parent_id, title, relevance: the best score of each over the fields, the k best, ties by id."""
    index = Index(spark, folder)
    terms = index.terms(query)
    stats = statistics(index, terms, fields)
    _, worth, _ = candidates(index, query, k, fields, stats)
    if worth is None:
        return spark.createDataFrame([], "id string, parent_id string, title string, relevance double")
    blocks = index.postings(terms, fields).join(worth.drop("bound"), ["segment", "field", "block"], "left_semi")
    x = _grouped(_hits(blocks, index, stats, terms), worth, index)
    return x.groupBy("id", "parent_id", "title").agg(F.max("relevance").alias("relevance")).orderBy(F.col("relevance").desc(), "id").limit(k)


def search_rows(source: DataFrame, embedding: DataFrame, insight: DataFrame, note: DataFrame) -> DataFrame:
    """field, id, parent, title, text of the six texts that are searched. A chunk is found for its source, all others for
    themselves."""
    titles = source.select(F.col("id").alias("source"), F.col("title").alias("source_title"))
    row = lambda df, field, text, title, parent="id": df.select(F.lit(field).alias("field"), "id", F.col(parent).alias("parent"), title.alias("title"), F.col(text).alias("text"))
    return reduce(DataFrame.unionByName, [
        row(source, "source title", "title", F.col("title")), row(source, "source text", "full_text", F.col("title")),
        row(embedding.join(titles, "source", "left"), "chunk", "content", F.col("source_title"), "source"),
        row(insight.join(titles, "source", "left"), "insight", "content", insight_title()),
        row(note, "note title", "title", F.col("title")), row(note, "note text", "content", F.col("title")),
    ])
