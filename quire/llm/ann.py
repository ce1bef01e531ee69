"""Approximate nearest neighbours by cross-polytope hashing with multiprobe, and exact reranking.

Each table turns a unit vector twice by pseudo-rotations (three times: random signs, fast Hadamard transform) and hashes
it to the nearest signed axis of either: a bucket is a pair of axes. Every row is indexed in every table. A query probes
the buckets whose two axes lie nearest to it in sum. How many is fitted: for a bounded sample of queries the true
neighbours are found by one scan of all rows, and as many buckets are probed as find `recall` of them (in the worst case
all buckets, which is exact). A query that meets fewer than k candidates this way, though there are more, is sent again
with all buckets of one table: its answer is exact.

Queries and rows meet in cells, one for each table and first axis: a query travels once to a cell with the list of second
axes that it probes there. A cell is split by the hash of the row's id into slices of about `SLICE_ROWS`, and its queries
stream past each slice, so neither a large cell nor many queries fill a task. Of equal vectors only the k + 1 smallest ids
can be among the k nearest, so copies beyond these are left out before the shuffle: an exact rule.
Scores are inner products of the original vectors in double precision, summed in one fixed order, so that equal
vectors tie exactly and ties go to the smaller id.

Vectors that are null or zero, that hold null or non-finite components, that have another number of components than
most (the smaller number, if two are equally frequent), or whose id is null take no part. Rows with one id are one
candidate, with its best score, and no query's own candidate; an empty table gives an empty result. Other columns are
left aside.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .durable import checkpointed

TABLES, SLICE_ROWS, SAMPLE_QUERIES = 8, 8192, 128
#: Seed of the sign vectors, the same on every machine.
SEED = 7


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of rows whose length is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


class Hasher:
    """Pairs of cross-polytope hashes for vectors of d components."""

    def __init__(self, d: int, tables: int = TABLES):
        self.d, self.tables = d, tables
        self.width = 1 << max(1, (d - 1).bit_length())
        self.axes = 2 * self.width
        self.buckets = self.axes**2
        self.signs = np.random.default_rng(SEED).choice(np.array([-1, 1], dtype=np.float32), (tables, 2, 3, self.width))

    def turned(self, x: np.ndarray, table: int, part: int) -> np.ndarray:
        """Products of the directions with the 2 x width signed axes, turned."""
        norms = np.linalg.norm(x.astype(np.float64), axis=1)
        y = np.zeros((len(x), self.width), dtype=np.float32)
        y[:, : self.d] = x / norms[:, None]
        for s in self.signs[table, part]:
            y = hadamard(y * s)
        return np.concatenate([y, -y], axis=1)

    def bucket(self, x: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
        """First and second axis."""
        return self.turned(x, table, 0).argmax(axis=1), self.turned(x, table, 1).argmax(axis=1)

    def probes(self, x: np.ndarray, table: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, first, second axis) of the n best buckets of each query, sorted by row and first axis.

        A pair that is the i-th best of its first and the j-th best of its second axes has i * j pairs at least as good
        (itself included), so only pairs with i * j <= n are looked at: about n * log n of them."""
        n = min(n, self.buckets)
        i, j = _pairs(n, self.axes)
        first, second = self.turned(x, table, 0), self.turned(x, table, 1)
        a, b = np.argsort(-first, axis=1, kind="stable"), np.argsort(-second, axis=1, kind="stable")
        sums = np.take_along_axis(first, a, axis=1)[:, i] + np.take_along_axis(second, b, axis=1)[:, j]
        best = np.argpartition(-sums, n - 1, axis=1)[:, :n]
        row = np.repeat(np.arange(len(x)), n)
        first, second = np.take_along_axis(a, i[best], axis=1).ravel(), np.take_along_axis(b, j[best], axis=1).ravel()
        order = np.lexsort((second, first, row))
        return row[order], first[order], second[order]

    def ranks(self, queries: np.ndarray, of: np.ndarray, buckets: np.ndarray) -> np.ndarray:
        """How many buckets query of[i] must probe, in the best table, to meet a row with the buckets[i] of all tables."""
        out = np.full(len(of), self.buckets, dtype=np.int64)
        for t in range(self.tables):
            first, second = self.turned(queries, t, 0), self.turned(queries, t, 1)
            for q in np.unique(of):
                mine = np.flatnonzero(of == q)
                a, b = buckets[mine, t] // self.axes, buckets[mine, t] % self.axes
                own, sorted_second = first[q][a] + second[q][b], np.sort(second[q])
                better = [int((self.axes - np.searchsorted(sorted_second, s - first[q], "right")).sum()) for s in own]
                out[mine] = np.minimum(out[mine], np.array(better) + 1)
        return np.minimum(out, self.buckets)


@lru_cache(maxsize=4)
def _pairs(n: int, axes: int) -> tuple[np.ndarray, np.ndarray]:
    """Places i, j from 0 with (i + 1) * (j + 1) <= n, both below axes."""
    most = [min(axes, n // (i + 1)) for i in range(min(axes, n))]
    return np.repeat(np.arange(len(most)), most), np.concatenate([np.arange(m) for m in most])


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _packed(x: np.ndarray) -> pa.Array:
    x = np.ascontiguousarray(x)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.arange(len(x) + 1, dtype=np.int32) * np.int32(x.shape[1] * x.itemsize)), pa.py_buffer(x)])


def _first_copies(ids: np.ndarray, x: np.ndarray, most: int) -> np.ndarray:
    """Rows that stay if of equal vectors only the `most` smallest different ids do."""
    if not len(ids):
        return np.zeros(0, dtype=np.int64)
    _, group = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, x.shape[1] * x.itemsize))).ravel(), return_inverse=True)
    order = np.lexsort((ids, group))
    g, v = group[order], ids[order]
    new = np.ones(len(g), dtype=bool)
    new[1:] = g[1:] != g[:-1]
    other = new.copy()
    other[1:] |= v[1:] != v[:-1]
    order, g, new = order[other], g[other], new[other]
    place = np.arange(len(g)) - np.maximum.accumulate(np.where(new, np.arange(len(g)), 0))
    return order[place < most]


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, summed in an order that depends on the length alone."""
    return np.add.reduce(a.astype(np.float64) * b.astype(np.float64), axis=1)


def nearest(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, rough: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, row of x, score) of each query's k best of x, itself excepted; equal scores by id.

    rough: products that are known already, -inf for rows that a query does not look at."""
    rough = queries.astype(np.float64) @ x.astype(np.float64).T if rough is None else rough
    rough[query_ids[:, None] == ids[None, :]] = -np.inf
    if rough.shape[1] > k:
        floor = np.partition(rough, rough.shape[1] - k, axis=1)[:, rough.shape[1] - k]
        slack = 1e-9 * np.linalg.norm(queries.astype(np.float64), axis=1) * np.linalg.norm(x.astype(np.float64), axis=1).max()
        rough[rough < (floor - slack)[:, None]] = -np.inf
    q, r = np.nonzero(np.isfinite(rough))
    score = _products(queries[q], x[r])
    order = np.lexsort((ids[r], -score, q))
    q, r, score = q[order], r[order], score[order]
    first = np.searchsorted(q, q)
    best = np.arange(len(q)) - first < k
    return q[best], r[best], score[best]


def _probed(queries: np.ndarray, axes: list[np.ndarray], x: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """Products of the queries with the rows of their second axes alone (no axes: all rows); x is sorted by axis."""
    x, queries = x.astype(np.float64), queries.astype(np.float64)
    out = np.full((len(queries), len(x)), -np.inf)
    sizes = np.array([len(a) for a in axes])
    of, flat = np.repeat(np.arange(len(axes)), sizes), np.concatenate([np.zeros(0, np.int64), *axes]).astype(np.int64)
    order = np.argsort(flat, kind="stable")
    of, flat = of[order], flat[order]
    for a in np.unique(flat):
        lo, hi = ptr[a], ptr[a + 1]
        if lo < hi:
            who = of[np.searchsorted(flat, a) : np.searchsorted(flat, a, "right")]
            out[who, lo:hi] = queries[who] @ x[lo:hi].T
    if (sizes == 0).any():
        out[sizes == 0] = queries[sizes == 0] @ x.T
    return out


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int]:
    """id and v (as they are) of the vectors that take part, and their number of components (0: none)."""
    v = F.col(vec_col)
    odd = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    x = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    x = x.where(~F.exists("v", odd) & F.exists("v", lambda c: c != 0))
    most = x.groupBy(F.size("v").alias("d")).count().orderBy(F.col("count").desc(), "d").first()
    return (x.where(F.size("v") == most.d), most.d) if most else (x.where(F.lit(False)), 0)


def fitted_probes(x: DataFrame, hasher: Hasher, is_query: Column, k: int, recall: float) -> int:
    """Buckets of each table that must be probed to find `recall` of the true neighbours of the sample.

    The sample: the SAMPLE_QUERIES queries with the smallest hash of their id, set against all rows, wherever these are."""
    sample = x.where(is_query).orderBy(F.xxhash64("id"), "id").limit(SAMPLE_QUERIES).collect()
    if not sample:
        return 1
    ids, queries = np.array([r.id for r in sample]), np.array([r.v for r in sample], dtype=np.float64)
    d = hasher.d

    def buckets(v: np.ndarray) -> np.ndarray:
        if not len(v):
            return np.zeros((0, hasher.tables), np.int64)
        pairs = [hasher.bucket(v, t) for t in range(hasher.tables)]
        return np.column_stack([a * hasher.axes + b for a, b in pairs])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, rows = np.zeros(0, np.int64), np.zeros((0, d))
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                part = b.slice(lo, 4096)
                own, rows = np.concatenate([own, part.column("id").to_numpy()]), np.concatenate([rows, _matrix(part.column("v"), d)])
                _, r, _ = nearest(ids, queries, own, rows, k)
                r = np.unique(r)
                own, rows = own[r], rows[r]
        q, r, score = nearest(ids, queries, own, rows, k) if len(own) else (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(own[r]), pa.array(score), pa.array(list(buckets(rows[r])), pa.list_(pa.int64()))], ["q", "id", "score", "buckets"])

    found = x.mapInArrow(scan, "q long, id long, score double, buckets array<long>")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc(), "id"))
    best = found.withColumn("place", place).where(F.col("place") <= k).select("q", "buckets").collect()
    if not best:
        return 1
    probes = np.sort(hasher.ranks(queries.astype(np.float32), np.array([r.q for r in best]), np.array([r.buckets for r in best])))
    return int(probes[min(len(probes) - 1, int(np.ceil(recall * len(probes))) - 1)])


def search(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20, recall: float = 0.96, tables: int = TABLES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of each query's k nearest. is_query: over the column `id`."""
    x, d = usable(vectors, id_col, vec_col)
    if not d:
        return x.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    hasher = Hasher(d, tables)
    probes = fitted_probes(x, hasher, is_query, k, recall)
    kind = "<f4" if x.schema["v"].dataType.elementType.simpleString() == "float" else "<f8"

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, m = b.column("id").to_numpy(), _matrix(b.column("v"), d)
            stays = _first_copies(ids, m, k + 1)
            ids, m = pa.array(ids[stays]), m[stays]
            v = _packed(m.astype(kind))
            for t in range(tables):
                first, second = hasher.bucket(m, t)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(m), t, np.int32)), pa.array(first.astype(np.int32)), ids, v, pa.array(second.astype(np.int32))], ["t", "first", "id", "v", "second"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 128):
                part = b.slice(lo, 128)
                m = _matrix(part.column("v"), d)
                v = _packed(m.astype(kind))
                for t in range(tables):
                    row, first, second = hasher.probes(m, t, probes)
                    begin = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (first[1:] != first[:-1])]))
                    at = pa.array(row[begin])
                    axes = pa.ListArray.from_arrays(np.append(begin, len(row)).astype(np.int32), pa.array(second.astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(begin), t, np.int32)), pa.array(first[begin].astype(np.int32)), part.column("id").take(at), v.take(at), axes], ["t", "first", "id", "v", "axes"])

    indexed = checkpointed(x.mapInArrow(index, "t int, first int, id long, v binary, second int"))
    asked = x.where(is_query).mapInArrow(probe, "t int, first int, id long, v binary, axes array<int>")
    # a row for each cell: tables x 2 x components (rounded up to a power of two) at most
    sizes = indexed.groupBy("t", "first").agg(F.ceil(F.count("*") / F.lit(SLICE_ROWS)).cast("int").alias("slices"))
    rows_of = indexed.join(F.broadcast(sizes), ["t", "first"]).withColumn("slice", F.pmod(F.xxhash64("id"), "slices").cast("int"))
    each_slice = F.explode(F.sequence(F.lit(0), F.col("slices") - 1))
    queries = asked.join(F.broadcast(sizes), ["t", "first"]).withColumn("slice", each_slice)
    cell = F.xxhash64("t", "first", "slice").alias("cell")

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        ready = None
        at = None
        for b in batches:
            keys, asks, ids = b.column("cell").to_numpy(), b.column("asks").to_numpy(), b.column("id").to_numpy()
            m = np.frombuffer(b"".join(b.column("v").to_pylist()), dtype=kind).reshape(-1, d)
            axes = b.column("axes")
            flat, ends = axes.flatten().to_numpy(), np.concatenate([[0], np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(axes), 0).to_numpy())])
            begin = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (asks[1:] != asks[:-1]), [True]])) if len(keys) else np.zeros(1, np.int64)
            found = []
            for lo, hi in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
                if keys[lo] != at:
                    held, ready, at = [], None, keys[lo]
                if not asks[lo]:
                    held.append((ids[lo:hi], m[lo:hi], flat[ends[lo] : ends[hi]]))
                    continue
                if ready is None:
                    own, rows, second = (np.concatenate(c) for c in zip(*held, strict=True))
                    stays = _first_copies(own, rows, k + 1)
                    stays = stays[np.argsort(second[stays], kind="stable")]
                    ready = own[stays], rows[stays], np.searchsorted(second[stays], np.arange(hasher.axes + 1))
                for a in range(lo, hi, 256):
                    z = min(a + 256, hi)
                    rough = _probed(m[a:z], [flat[ends[i] : ends[i + 1]] for i in range(a, z)], ready[1], ready[2])
                    q, r, score = nearest(ids[a:z], m[a:z], ready[0], ready[1], k, rough)
                    found.append((ids[a:z][q], ready[0][r], score))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], ["query_id", "vec_id", "score"])

    def ranked(rows_of: DataFrame, queries: DataFrame) -> DataFrame:
        met = rows_of.select(cell, F.lit(0).alias("asks"), "id", "v", F.array("second").alias("axes")).unionByName(queries.select(cell, F.lit(1).alias("asks"), "id", "v", "axes"))
        hits = met.repartition("cell").sortWithinPartitions("cell", "asks").mapInArrow(rerank, "query_id long, vec_id long, score double")
        # dealt by query once: the same candidate from several tables, and the k best
        best = hits.repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
        return best.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    found = checkpointed(ranked(rows_of, queries))
    met = found.groupBy(F.col("query_id").alias("id")).agg(F.count("*").alias("n"))
    few = checkpointed(x.where(is_query).select("id").distinct().join(met, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n")).where(F.col("n") < k))
    if few.isEmpty():
        return found
    few = few.where(F.col("n") < min(k, x.select("id").distinct().count() - 1)).select("id")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), _packed(_matrix(b.column("v"), d).astype(kind))], ["id", "v"])

    # each row is once in each table, so all cells of one table are enough
    again = x.where(is_query).join(few, "id", "left_semi").select("id", "v").mapInArrow(packed, "id long, v binary")
    again = again.crossJoin(F.broadcast(sizes.where("t = 0"))).withColumn("slice", each_slice).withColumn("axes", F.array().cast("array<int>"))
    return found.join(few.withColumnRenamed("id", "query_id"), "query_id", "left_anti").unionByName(ranked(rows_of.where("t = 0"), again))
