"""MinHash near-dedup with b-bit signatures and exact confirmation.

One pass over the texts gives each its set of distinct word shingles (64-bit hashes), a 128-bit hash of the set, the
minima of 128 random orders, their two lowest (mixed) bits packed into four longs, and 24 band keys of four minima.
Texts with equal sets are one class, so copies count once from here on. Classes that share a band key are candidates:

1. each class is paired with the smallest class of each of its buckets (a count and a join, never all pairs),
2. components are formed of the pairs that are links, and
3. in buckets that still hold several components, classes of different components are compared by longer signatures
   (1024 orders) in blocks inside tasks, each pair in the first bucket that it shares. Classes that may have a link there
   meet once more in the same blocks with their full sets, and links come out as a spanning forest, never as all pairs.

A pair's similarity is estimated from equal bits, less those that agree by chance; pairs whose estimate lies five
standard errors below the threshold, or whose set sizes rule a link out, go no further: of texts that share 70 % of their
shingles, one pair in a million passes at 85 %. All links are confirmed on full sets. At similarity 0.8 a pair shares no
band with a probability of 3e-6 (0.85: 2e-8), and fails the estimate with 3e-7: that is what may be lost.

Words: A-Z lower-cased, runs of `[^\\x20\\x09-\\x0D]`. A text with fewer words than a shingle has one shingle, all its
words. Null, empty and blank texts have the empty set, are linked with nothing and stay. Rows with a null id count as
the last ones: their component is null only if it holds no other id, and then they stay. Repeated rows fall into one
class and stay or go together. An empty table gives an empty result. Other columns are left aside.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected, joined_back
from .durable import checkpointed
from .words import Texts, mix, slices

#: Random orders, bits of each minimum that a signature keeps, bands and minima in a band (bands come from the first ones).
ORDERS, BITS, BANDS, BAND_MINIMA = 128, 2, 24, 4
#: Orders of the longer signature; the first ones are the same.
LONG_ORDERS = 1024
#: Rows of a bucket that are compared with as many others at once, and shingles that they hold about.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 19
#: Stands for a null id: behind all others.
_NULL_ID = (1 << 63) - 1
_rng = np.random.default_rng(8)
_A = (_rng.integers(0, 1 << 31, LONG_ORDERS, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, LONG_ORDERS, dtype=np.uint32)
_SEEDS = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted inside each row, and the rows' boundaries in them."""
    t = Texts(column, lower=True)
    h = t.hashes()
    grams, whole = t.grams(h, n)
    for few in range(1, n):
        at = t.ptr[:-1][t.counts == few]
        if len(at):
            grams[at], whole[at] = t.grams(h, few)[0][at], True
    sizes = np.where(t.counts > 0, np.maximum(t.counts - n + 1, 1), 0)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    x = grams[whole]
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        x[a:b].sort()
    new = np.ones(len(x), dtype=bool)
    new[1:] = x[1:] != x[:-1]
    new[ends[:-1][sizes > 0]] = True
    return x[new], np.concatenate([[0], np.cumsum(new)])[ends]


def _minima(x: np.ndarray, starts: np.ndarray, orders: int) -> np.ndarray:
    """The minimum of each order over each of the (not empty) sets that begin at `starts`."""
    short = (x >> np.uint64(32)).astype(np.uint32)
    out = np.empty((orders, len(starts)), dtype=np.uint64)
    for i in range(orders):
        out[i] = np.minimum.reduceat(short * _A[i] + _B[i], starts)
    return out


def _bits(minima: np.ndarray) -> np.ndarray:
    """The lowest (mixed) bits of the minima, packed: a row of longs for each set."""
    low, per = mix(minima) & np.uint64((1 << BITS) - 1), 64 // BITS
    out = np.zeros((minima.shape[1], len(minima) // per), dtype=np.uint64)
    for i in range(len(minima)):
        out[:, i // per] |= low[i] << np.uint64(BITS * (i % per))
    return out


def sketches(x: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row: the set's hash (two longs), the packed signature (four longs) and the band keys; 0 for empty sets."""
    rows = len(ptr) - 1
    filled = np.flatnonzero(ptr[1:] > ptr[:-1])
    sets, signature, bands = np.zeros((rows, 2), np.uint64), np.zeros((rows, ORDERS * BITS // 64), np.uint64), np.zeros((rows, BANDS), np.uint64)
    if not len(filled):
        return sets, signature, bands
    starts = ptr[:-1][filled]
    with np.errstate(over="ignore"):
        sets[filled, 0] = mix(np.add.reduceat(mix(x ^ np.uint64(0x5851F42D4C957F2D)), starts))
        sets[filled, 1] = mix(np.add.reduceat(mix(x + np.uint64(0x14057B7EF767814F)), starts))
        minima = _minima(x, starts, ORDERS)
        signature[filled] = _bits(minima)
        for k in range(BANDS):
            key = np.full(len(filled), _SEEDS[k])
            for m in minima[k * BAND_MINIMA : (k + 1) * BAND_MINIMA]:
                key = mix(key + m)
            bands[filled, k] = key
    return sets, signature, bands


def least_equal(threshold: float, orders: int = ORDERS) -> int:
    """Equal minima that a pair at the threshold shows but for three in ten million: five standard errors less."""
    chance = 1 / (1 << BITS)
    p = threshold + (1 - threshold) * chance
    return int(np.floor(orders * p - 5 * np.sqrt(orders * p * (1 - p))))


def equal_minima(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many of the packed minima agree; rows of longs against rows of longs."""
    d = a ^ b
    d = (d | (d >> np.uint64(1))) & np.uint64(0x5555555555555555)
    return a.shape[-1] * 64 // BITS - np.bitwise_count(d).sum(axis=-1).astype(np.int64)


def _batches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """i (the id), x (hash of the text) and text; i and x together name a class by its first row."""
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)).alias("i"), F.xxhash64(text_col).alias("x"), F.col(text_col).alias("text"))


def _node(i: str = "i", x: str = "x") -> Column:
    return F.struct(F.col(i).alias("i"), F.col(x).alias("x"))


_SKETCH = "i long, x long, n int, set0 long, set1 long, signature array<long>, bands array<long>"


def sketch(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """One row for each document, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = lambda a: pa.ListArray.from_arrays(np.arange(len(a) + 1, dtype=np.int32) * a.shape[1], pa.array(a.view(np.int64).ravel()))
        for b in (s for b in batches for s in slices(b, "text")):
            grams, ptr = shingle_sets(b.column("text"), words)
            sets, signature, bands = sketches(grams, ptr)
            yield pa.RecordBatch.from_arrays([b.column("i"), b.column("x"), pa.array(np.diff(ptr).astype(np.int32)), pa.array(sets[:, 0].view(np.int64)), pa.array(sets[:, 1].view(np.int64)), lists(signature), lists(bands)], ["i", "x", "n", "set0", "set1", "signature", "bands"])

    return _batches(docs, id_col, text_col).mapInArrow(run, _SKETCH)


def full_sets(rows: DataFrame, words: int) -> DataFrame:
    """node and its set (array<long>) of rows i, x, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (s for b in batches for s in slices(b, "text")):
            grams, ptr = shingle_sets(b.column("text"), words)
            yield pa.RecordBatch.from_arrays([b.column("i"), b.column("x"), pa.ListArray.from_arrays(ptr.astype(np.int32), pa.array(grams.view(np.int64)))], ["i", "x", "grams"])

    return rows.select("i", "x", "text").mapInArrow(run, "i long, x long, grams array<long>").select(_node().alias("node"), "grams")


def long_signatures(sets: DataFrame) -> DataFrame:
    """node, n and the longer signature (binary) of nodes and their sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("grams")
            sizes = pa.compute.list_value_length(lists).to_numpy()
            ends = np.concatenate([[0], np.cumsum(sizes)])
            flat = lists.flatten().to_numpy().view(np.uint64)
            for lo in range(0, b.num_rows, 512):
                hi = min(lo + 512, b.num_rows)
                part = _bits(_minima(flat[ends[lo] : ends[hi]], ends[lo:hi] - ends[lo], LONG_ORDERS)) if hi > lo else np.zeros((0, 1))
                yield pa.RecordBatch.from_arrays([b.column("i").slice(lo, hi - lo), b.column("x").slice(lo, hi - lo), pa.array(sizes[lo:hi].astype(np.int32)), pa.array([r.tobytes() for r in part], pa.binary())], ["i", "x", "n", "signature"])

    x = sets.select("node.i", "node.x", "grams").mapInArrow(run, "i long, x long, n int, signature binary")
    return x.select(_node().alias("node"), "n", "signature")


def _agreeing(a: Column, b: Column) -> Column:
    """equal_minima() as a Spark expression."""
    parts = []
    for k in range(ORDERS * BITS // 64):
        d = F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))
        parts.append(F.bit_count(d.bitwiseOR(F.shiftright(d, 1)).bitwiseAND(F.lit(0x5555555555555555))))
    return F.lit(ORDERS) - sum(parts[1:], parts[0])


def _cells(rows: DataFrame) -> DataFrame:
    """rows: g, node, comp, n and more. Deals rows of groups with several components to cells (r, c) so that any two rows
    of one group and different components meet in one cell, which holds about two blocks at most.

    The group's largest component is never set against itself: that is what keeps large groups of copies linear."""
    sizes = rows.groupBy("g", "comp").agg(F.count("*").alias("k"), F.sum("n").alias("n"))
    most = sizes.groupBy("g").agg(F.max(F.struct("k", "comp", "n")).alias("most"), F.sum("k").alias("k"), F.sum("n").alias("n"), F.count("*").alias("comps")).where("comps > 1")
    blocks = lambda k, n: F.greatest(F.ceil(k / F.lit(BLOCK)), F.ceil(n / F.lit(BLOCK_SHINGLES))).cast("int")
    most = most.select("g", "k", F.col("n").alias("n_all"), F.col("most.comp").alias("main"), blocks(F.col("most.k"), F.col("most.n")).alias("mains"), blocks(F.col("k") - F.col("most.k"), F.col("n") - F.col("most.n")).alias("others"))
    x = joined_back(rows, most, "g").withColumn("is_main", F.col("comp") == F.col("main"))
    own = F.pmod(F.xxhash64("node"), F.when(F.col("is_main"), F.col("mains")).otherwise(F.col("others"))).cast("int")
    x = x.withColumn("block", own)
    cell = lambda r, c: F.struct(r.cast("int").alias("r"), c.cast("int").alias("c"))
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    main = F.transform(upto(F.col("others")), lambda j: cell(j, F.col("others") + F.col("block")))
    other = F.transform(upto(F.col("others") + F.col("mains")), lambda j: F.when(j < F.col("block"), cell(j, F.col("block"))).otherwise(cell(F.col("block"), j)))
    small = (F.col("k") <= BLOCK) & (F.col("n_all") <= BLOCK_SHINGLES)  # a group that is one cell
    x = x.withColumn("cell", F.explode(F.when(small, F.array(cell(F.lit(0), F.lit(0)))).when(F.col("is_main"), main).otherwise(other)))
    # in cell (r, r) all rows are on the right as on the left
    left = ~F.col("is_main") & (F.col("block") == F.col("cell.r"))
    right = F.col("is_main") | (F.col("block") == F.col("cell.c"))
    return x.withColumn("cell_key", F.xxhash64("g", "cell")).withColumn("on_left", left).withColumn("on_right", right).drop("main", "mains", "others", "is_main", "block", "k", "n_all", "cell")


def _labels(linked: np.ndarray, left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """Smallest index of each one's component, given which of left and right are linked."""
    label = np.arange(n)
    rows, cols = np.nonzero(linked)
    u, v = left[rows], right[cols]
    while True:
        new = label.copy()
        np.minimum.at(new, u, label[v])
        np.minimum.at(new, v, label[u])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _common(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections, from products of 0-1 matrices over shingles that several sets hold."""
    sizes = np.array([len(s) for s in sets])
    of = np.repeat(np.arange(len(sets)), sizes)
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.cumsum(count > 1) - 1
    keep = count[column] > 1
    of, column = of[keep], shared[column[keep]]
    order = np.argsort(column, kind="stable")
    of, column = of[order], column[order]
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    width = 2048
    cuts = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else -1) + 1 + width, width))
    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        if a < b:
            x = np.zeros((len(sets), width), dtype=np.float32)
            x[of[a:b], column[a:b] - k * width] = 1
            out += x[left] @ x[right].T
    return np.rint(out).astype(np.int64)


def _by_cell(batches: Iterator[pa.RecordBatch], most: int = 8 << 20) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole cells (about `most` bytes, or one cell), for rows that come sorted by cell_key, and where each begins."""
    held: list[pa.RecordBatch] = []
    size = 0

    def whole() -> tuple[pa.Table, np.ndarray]:
        t = pa.Table.from_batches(held).combine_chunks()
        key = t["cell_key"].to_numpy()
        return t, np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))

    for b in batches:
        if not b.num_rows:
            continue
        key = b.column("cell_key").to_numpy()
        for lo, hi in itertools.pairwise(np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]])).tolist()):
            part = b.slice(lo, hi - lo)
            if size > most and key[lo] != held[-1].column("cell_key")[0].as_py():
                yield whole()
                held, size = [], 0
            held.append(part)
            size += part.nbytes
    if held:
        yield whole()


_CELL = "cell_key long, on_left boolean, on_right boolean, i long, x long, ci long, cx long"


def _flat(cells: DataFrame, *more: str) -> DataFrame:
    return cells.select("cell_key", "on_left", "on_right", F.col("node.i").alias("i"), F.col("node.x").alias("x"), F.col("comp.i").alias("ci"), F.col("comp.x").alias("cx"), *more)


def _apart(t: pa.Table, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the rows a and b belong to different components."""
    ci, cx = t["ci"].to_numpy(), t["cx"].to_numpy()
    return (ci[a][:, None] != ci[b][None, :]) | (cx[a][:, None] != cx[b][None, :])


def _alike(cells: DataFrame, percent: int) -> DataFrame:
    """The rows of cells that may be linked to one of another component there, by sizes and signatures.

    cells: band (which one g is a key of), bands (all keys) and signature besides; a pair counts in its first common band."""
    x = _flat(cells, "n", "band", "bands", "signature")
    first, all_ = least_equal(percent / 100), least_equal(percent / 100, LONG_ORDERS)
    short = ORDERS * BITS // 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, begin in _by_cell(batches):
            sides = [t[c].to_numpy(zero_copy_only=False) for c in ("on_left", "on_right")]
            n, band = t["n"].to_numpy().astype(np.int64), t["band"].to_numpy()
            s = np.frombuffer(b"".join(t["signature"].to_pylist()), dtype=np.uint64).reshape(len(n), -1)
            bands = t["bands"].combine_chunks().flatten().to_numpy().reshape(len(n), -1)
            hit = np.zeros(len(n), dtype=bool)
            for lo, hi in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
                left, right = lo + np.flatnonzero(sides[0][lo:hi]), lo + np.flatnonzero(sides[1][lo:hi])
                for k in range(0, len(left), 256):  # a few rows against all of the block at once
                    a = left[k : k + 256]
                    ok = _apart(t, a, right)
                    ok &= 100 * np.minimum(n[a][:, None], n[right][None, :]) >= percent * np.maximum(n[a][:, None], n[right][None, :])
                    ok &= equal_minima(s[a][:, None, :short], s[right][None, :, :short]) >= first
                    p, q = np.nonzero(ok)
                    p, q = a[p], right[q]
                    for z in range(0, len(p), 1 << 15):
                        u, v = p[z : z + (1 << 15)], q[z : z + (1 << 15)]
                        same = (equal_minima(s[u], s[v]) >= all_) & ((bands[u] == bands[v]).argmax(axis=1) == band[u])
                        hit[u[same]] = hit[v[same]] = True
            yield pa.RecordBatch.from_arrays([t[c].combine_chunks().filter(pa.array(hit)) for c in ("cell_key", "on_left", "on_right", "i", "x", "ci", "cx")], ["cell_key", "on_left", "on_right", "i", "x", "ci", "cx"])

    # rows are dealt by cell, and a cell is bounded
    out = x.repartition("cell_key").sortWithinPartitions("cell_key").mapInArrow(run, _CELL)
    return out.select("cell_key", "on_left", "on_right", _node().alias("node"), _node("ci", "cx").alias("comp"))


def _links(cells: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of components that links connect: a spanning forest of each cell. cells: rows with their sets (grams)."""
    x = _flat(cells, "grams")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, begin in _by_cell(batches):
            sides = [t[c].to_numpy(zero_copy_only=False) for c in ("on_left", "on_right")]
            grams = t["grams"].combine_chunks()
            n = pa.compute.list_value_length(grams).to_numpy().astype(np.int64)
            flat, ptr = grams.flatten().to_numpy().view(np.uint64), np.concatenate([[0], np.cumsum(n)])
            found = [np.zeros((0, 2), dtype=np.int64)]
            for lo, hi in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
                left, right = np.flatnonzero(sides[0][lo:hi]), np.flatnonzero(sides[1][lo:hi])
                ok = _apart(t, lo + left, lo + right)
                if ok.any():
                    common = _common([flat[a:b] for a, b in zip(ptr[lo:hi], ptr[lo + 1 : hi + 1], strict=True)], left, right)
                    ok &= 100 * common >= percent * (n[lo + left][:, None] + n[lo + right][None, :] - common)
                    label = _labels(ok, left, right, hi - lo)
                    at = np.flatnonzero(label != np.arange(hi - lo))
                    found.append(np.column_stack([at, label[at]]) + lo)
            e = np.concatenate(found)
            yield pa.RecordBatch.from_arrays([pa.array(t[c].to_numpy()[e[:, k]]) for k in (0, 1) for c in ("ci", "cx")], ["ai", "ax", "bi", "bx"])

    out = x.repartition("cell_key").sortWithinPartitions("cell_key").mapInArrow(run, "ai long, ax long, bi long, bx long")
    return out.distinct().select(_node("ai", "ax").alias("a"), _node("bi", "bx").alias("b"))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id that links reach) and kept (whether that is its own id) of each row.

    Documents are linked if 100 * shared shingles >= percent * shingles of both; ids are integers."""
    out = _judged(docs, id_col, text_col, words, percent)
    return out.select(F.nullif("i", F.lit(_NULL_ID)).alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.nullif("c.i", F.lit(_NULL_ID)).alias("component_id"), (F.col("i") == F.col("c.i")).alias("kept"))


def _judged(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    """i, x, n (shingles) and c (i and x of the first row of its component) of each row."""
    rows = _batches(docs, id_col, text_col)
    sketched = checkpointed(sketch(docs, id_col, text_col, words))
    first = F.min(F.struct("i", "x", "n", "signature", "bands")).alias("first")
    classes = sketched.where("n > 0").groupBy("set0", "set1").agg(first)
    classes = checkpointed(classes.select("set0", "set1", _node("first.i", "first.x").alias("node"), "first.n", "first.signature", "first.bands"))
    banded = classes.select("node", "n", F.posexplode("bands").alias("band", "g"))
    buckets = banded.groupBy("g").agg(F.min("node").alias("rep"), F.count("*").alias("k")).where("k > 1").drop("k")
    members = checkpointed(joined_back(banded, buckets, "g"))

    needed = members.select("node").distinct().select("node.i", "node.x")
    texts = rows.join(needed, ["i", "x"], "left_semi").groupBy("i", "x").agg(F.first("text").alias("text"))
    sets = checkpointed(full_sets(texts, words))

    signs = classes.select("node", "n", "signature")
    of = lambda df, c: df.select(F.col("node").alias(c), *[F.col(k).alias(f"{k}_{c}") for k in df.columns if k != "node"])
    alike = least_equal(percent / 100)

    def confirmed(pairs: DataFrame) -> DataFrame:
        both = pairs.join(of(sets, "a"), "a").join(of(sets, "b"), "b").select("a", "b", F.size("grams_a").alias("n_a"), F.size("grams_b").alias("n_b"), F.size(F.array_intersect("grams_a", "grams_b")).alias("common"))
        return both.where(100 * F.col("common") >= percent * (F.col("n_a") + F.col("n_b") - F.col("common"))).select("a", "b")

    pairs = members.where("node <> rep").select(F.col("node").alias("a"), F.col("rep").alias("b")).distinct()
    pairs = pairs.join(of(signs, "a"), "a").join(of(signs, "b"), "b")
    pairs = pairs.where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")).where(_agreeing(F.col("signature_a"), F.col("signature_b")) >= alike)
    comps = checkpointed(connected(confirmed(pairs.select("a", "b"))))

    def component(df: DataFrame) -> DataFrame:
        return df.join(comps, "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root")

    mixed = checkpointed(_cells(component(members.drop("rep"))))
    long = long_signatures(sets.join(mixed.select("node").distinct(), "node", "left_semi")).join(classes.select("node", "bands"), "node")
    may = _alike(mixed.drop("n").join(long, "node"), percent)
    joins = checkpointed(connected(_links(may.join(sets, "node"), percent)))

    roots = joins.select(F.col("node").alias("comp"), F.col("root").alias("last"))
    of_class = component(classes.select("set0", "set1", "node")).join(roots, "comp", "left").select(F.struct("set0", "set1").alias("s"), F.coalesce("last", "comp").alias("c"))
    filled = joined_back(sketched.where("n > 0").select("i", "x", "n", F.struct("set0", "set1").alias("s")), of_class, "s").select("i", "x", "n", "c")
    return filled.unionByName(sketched.where("n = 0").select("i", "x", "n", _node().alias("c")))


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that are kept, all columns, whatever their names: of each group those with its smallest id, null last,
    and of different texts with that id one. Rows that are repeated in id and text stay together."""
    x = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    id_, text = (f"c{docs.columns.index(c)}" for c in (id_col, text_col))
    first = _judged(x, id_, text, words, percent).where((F.col("i") == F.col("c.i")) & (F.col("x") == F.col("c.x"))).select("i", "x").distinct()
    kept = x.join(first, (F.coalesce(F.col(id_).cast("long"), F.lit(_NULL_ID)) == F.col("i")) & (F.xxhash64(text) == F.col("x")), "left_semi")
    return kept.toDF(*docs.columns)
