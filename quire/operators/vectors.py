"""Cosine top-k over stored vectors, exact, from the blocks that can hold one of the k best.

An index is a folder of Parquet tables that every machine sees:

    centroids  cell, centre                                      of a k-means fit on a sample; at most CELLS rows
    blocks     cell, block, n, near, far                         what the bound needs: distances to the centre
    codes      cell, block, id, scale, err, code                 the unit vector less its centre, in bytes
    vectors    cell, block, id, embedding, other columns         in folders of cells

Vectors are taken as unit vectors. Inside a cell they are in order of their distance to its centre and cut into blocks, so a
block is a ring. A query that is d away from the centre is at least near - d and d - far away from the ring's vectors, and at
distance e the cosine is 1 - e²/2: a bound for the block. The best few blocks give a k-th similarity; only blocks whose bound
reaches it are opened, of those only the byte codes, and only vectors whose code, with its error, can reach it are scored in
double precision. All results are those of a scan, whatever cells the fit has found; ties are kept.

Vectors of another length than the index's, null or zero ones and such with null or non-finite components are left out, as a
scan leaves them out. Ids are given once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .durable import checkpointed, read_by, write_by
from .ranges import numbered
from .search import cosine, insight_title

#: Most cells, rows that the fit sees at most (those with the smallest hash of their id) and its rounds, vectors of a block.
CELLS, SAMPLE, ROUNDS, BLOCK = 1024, 20_000, 8, 256
#: Blocks that are scored first.
FIRST = 4
#: What rounding can do to a bound.
SLACK = 1e-9


def fit(sample: np.ndarray, cells: int) -> np.ndarray:
    """Centres of k-means on unit vectors; the first are spread over the sample."""
    centres = sample[np.linspace(0, len(sample) - 1, min(cells, len(sample))).astype(int)].copy()
    for _ in range(ROUNDS):
        nearest = np.argmax(sample @ centres.T - (centres**2).sum(1) / 2, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        counts = np.bincount(nearest, minlength=len(centres))
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


def _units(column: pa.Array, dims: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    return x / np.sqrt((x * x).sum(1))[:, None]


def write(rows: DataFrame, folder: str, dims: int, vector: str = "embedding", cells: int | None = None) -> None:
    """Writes an index of rows (id, vector, other columns)."""
    double = F.col(vector).cast("array<double>")
    sound = (F.size(double) == dims) & F.forall(double, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(double, lambda v: v != 0)
    x = rows.where(F.col("id").isNotNull() & sound).withColumn(vector, double)
    n = x.count()
    sample = x.select("id", vector).orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()[vector].combine_chunks()  # bounded
    wanted = cells or max(1, min(CELLS, int((n / BLOCK) ** 0.5 * 4)))
    centres = fit(_units(sample, dims), wanted) if n else np.zeros((0, dims))
    spark = rows.sparkSession
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{folder}/centroids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            u = _units(b.column(vector), dims)
            cell = np.argmax(u @ centres.T - (centres**2).sum(1) / 2, axis=1)
            rest = u - centres[cell]
            scale = np.maximum(np.abs(rest).max(1) / 127, 1e-300)
            code = np.rint(rest / scale[:, None]).astype(np.int8)
            err = np.sqrt(((rest - code * scale[:, None]) ** 2).sum(1))
            codes = pa.ListArray.from_arrays(pa.array(np.arange(0, code.size + 1, dims, dtype=np.int32)), pa.array(code.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(np.sqrt((rest * rest).sum(1))), pa.array(scale), pa.array(err), codes], [*b.schema.names, "cell", "away", "scale", "err", "code"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in x.schema.fields)
    dealt = x.mapInArrow(run, f"{fields}, cell int, away double, scale double, err double, code array<tinyint>")
    # in order of cell and distance over all tasks; a task numbers its own blocks, so a large cell has several tasks
    order = ["cell", "away", "id"]
    dealt = checkpointed(dealt.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()))
    dealt = dealt.withColumn("block", F.expr(f"place div {BLOCK}"))
    dealt.groupBy("cell", "block").agg(F.count("*").cast("int").alias("n"), F.min("away").alias("near"), F.max("away").alias("far")).write.mode("overwrite").parquet(f"{folder}/blocks")
    write_by(dealt.select("cell", "block", "id", "scale", "err", "code"), f"{folder}/codes", "cell")
    write_by(dealt.drop("place", "away", "scale", "err", "code"), f"{folder}/vectors", "cell")


def _read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}")


def bounds(spark: SparkSession, folder: str, q: list[float]) -> DataFrame:
    """cell, block, n and the most similar that a vector of the block can be."""
    size = float(np.sqrt(np.dot(q, q)))
    unit = F.array(*[F.lit(float(v) / size) for v in q])
    apart = F.sqrt(F.aggregate(F.zip_with("centre", unit, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)).alias("apart")
    centres = _read(spark, folder, "centroids").select("cell", apart)
    x = _read(spark, folder, "blocks").join(F.broadcast(centres), "cell")  # at most CELLS rows
    e = F.greatest(F.lit(0.0), F.col("near") - F.col("apart"), F.col("apart") - F.col("far"))
    return x.select("cell", "block", "n", (1 - e * e / 2 + SLACK).alias("bound"))


def _opened(spark: SparkSession, folder: str, name: str, worth: DataFrame) -> DataFrame:
    """Rows of the blocks; other cells' folders are not listed, at most CELLS are."""
    cells = [r.cell for r in worth.select("cell").distinct().collect()]
    return read_by(spark, f"{folder}/{name}").where(F.col("cell").isin(cells)).join(worth.select("cell", "block"), ["cell", "block"], "left_semi")


def _coded(q: list[float], spark: SparkSession, folder: str) -> tuple[DataFrame, Column]:
    """Similarity of the query to each centre, and to a code."""
    size = float(np.sqrt(np.dot(q, q)))
    unit = F.array(*[F.lit(float(v) / size) for v in q])
    dot = lambda v: F.aggregate(F.zip_with(v, unit, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return _read(spark, folder, "centroids").select("cell", dot("centre").alias("base")), dot("code")


def plan(spark: SparkSession, folder: str, q: list[float], k: int, least: float) -> tuple[DataFrame, DataFrame, float]:
    """All blocks with their bounds, those that are opened, and the similarity that a vector must reach."""
    heads = checkpointed(bounds(spark, folder, q))
    first = heads.orderBy(F.col("bound").desc(), "cell", "block").limit(FIRST)
    top = _opened(spark, folder, "vectors", first).select(cosine(F.col("embedding"), q).alias("s")).where(F.col("s") >= least).orderBy(F.col("s").desc()).limit(k).agg(F.count("*").alias("n"), F.min("s").alias("low")).first()
    reach = max(least, top.low) if top.n == k else least
    return heads, heads.where(F.col("bound") >= reach - SLACK), reach


def nearest(spark: SparkSession, folder: str, q: list[float], k: int, least: float = -1.0) -> DataFrame:
    """The k rows most similar to q, at least `least`, ties by id; adds similarity. q has the index's length and is not zero."""
    _, worth, reach = plan(spark, folder, q, k, least)
    base, dot = _coded(q, spark, folder)
    codes = _opened(spark, folder, "codes", worth).join(F.broadcast(base), "cell")  # at most CELLS rows
    maybe = codes.where(F.col("base") + F.col("scale") * dot + F.col("err") >= reach - SLACK).select("cell", "block", "id")
    x = _opened(spark, folder, "vectors", worth).join(maybe, ["cell", "block", "id"], "left_semi")
    x = x.withColumn("similarity", cosine(F.col("embedding"), q)).where(F.col("similarity") >= least)
    return x.drop("cell", "block").orderBy(F.col("similarity").desc(), "id").limit(k)


def nearest_of_many(queries: DataFrame, rows: DataFrame, k: int, least: float, at_once: int = 256) -> DataFrame:
    """query, id, similarity: for each of the queries (query, vector) the k rows (id, embedding) most similar, ties by id.

    A stated set of queries against all rows, `at_once` of them in one scan, which is all that the driver ever holds. A batch
    of rows puts out its own k best of each query only. Rows or queries that are null, zero or of other lengths do not meet."""
    asked = checkpointed(numbered(queries.where(F.col("vector").isNotNull()).select("query", "vector"), ["query"], "number"))
    parts = []
    for first in range(1, asked.count() + 1, at_once):
        some = asked.where((F.col("number") >= first) & (F.col("number") < first + at_once)).orderBy("number").collect()
        parts.append(_scan(rows, [r.query for r in some], [list(map(float, r.vector)) for r in some], k, least, queries.schema["query"].dataType.simpleString()))
    if not parts:
        return queries.sparkSession.createDataFrame([], f"query {queries.schema['query'].dataType.simpleString()}, id {rows.schema['id'].dataType.simpleString()}, similarity double")
    return _first_of_each(reduce(DataFrame.unionByName, parts), k)


def _first_of_each(hits: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("similarity").desc(), "id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")


def search_of_many(queries: DataFrame, k: int, source: DataFrame, embedding: DataFrame, insight: DataFrame, note: DataFrame, least: float = 0.2) -> DataFrame:
    """query, id, parent_id, title, similarity, matches: what vector_search() gives, for each of the queries (query, vector)."""
    titles = source.select(F.col("id").alias("source"), F.col("title").alias("source_title"))

    def found(rows: DataFrame, *columns: str) -> DataFrame:
        return nearest_of_many(queries, rows, k, least).join(rows.select("id", *columns), "id")

    item = ["query", "id", "parent_id", "title", "content", "similarity"]
    parts = [
        found(embedding, "source", "content").join(titles, "source", "left").withColumns({"id": F.col("source"), "parent_id": F.col("source"), "title": F.col("source_title")}).select(*item),
        found(insight, "source", "insight_type", "content").join(titles, "source", "left").withColumns({"parent_id": F.col("source"), "title": insight_title()}).select(*item),
        found(note, "title", "content").withColumn("parent_id", F.col("id")).select(*item),
    ]
    matches = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("similarity")).alias("s"), "content"))), lambda m: m["content"])  # at most 3 k
    x = reduce(DataFrame.unionByName, parts).distinct().where(F.col("id").isNotNull())
    return _first_of_each(x.groupBy("query", "id", "parent_id", "title").agg(F.max("similarity").alias("similarity"), matches.alias("matches")), k)


def _scan(rows: DataFrame, names: list, vectors: list[list[float]], k: int, least: float, kind: str) -> DataFrame:
    by_length: dict[int, list[int]] = {}
    for i, v in enumerate(vectors):
        if any(v):
            by_length.setdefault(len(v), []).append(i)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths = b.column("embedding").value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
            for dims, which in by_length.items():
                part = b.filter(pa.array(lengths == dims))
                if not part.num_rows:
                    continue
                x = part.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
                q = np.array([vectors[i] for i in which])
                with np.errstate(invalid="ignore", divide="ignore"):
                    s = (x @ q.T) / (np.sqrt((x * x).sum(1))[:, None] * np.sqrt((q * q).sum(1))[None, :])
                norms = np.sqrt((x * x).sum(axis=1))
                for j, i in enumerate(which):
                    at = np.flatnonzero(s[:, j] >= least - SLACK)
                    if len(at) > k:
                        low = np.partition(s[at, j], len(at) - k)[len(at) - k]
                        at = at[s[at, j] >= low - SLACK]  # ties stay
                    # of a matrix product equal rows may differ in the last bit; row by row they do not
                    exact = (x[at] * q[j]).sum(axis=1) / (norms[at] * np.sqrt((q[j] * q[j]).sum()))
                    at, exact = at[exact >= least], exact[exact >= least]
                    if len(at):
                        yield pa.RecordBatch.from_arrays([pa.array([names[i]] * len(at)), part.column("id").take(pa.array(at)), pa.array(exact)], ["query", "id", "similarity"])

    return rows.select("id", "embedding").mapInArrow(run, f"query {kind}, id {rows.schema['id'].dataType.simpleString()}, similarity double")
