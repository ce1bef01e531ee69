"""Substring dedup with truncated suffix trees over prefix-partitioned, memory-sized groups; exact on words.

A suffix of the corpus starts at each word; what counts of it are its first `words` words. Equal ones are to be found,
and all but the earliest are repeats. Consecutive repeats make a longer one, so the runs that come out are maximal.

0. A suffix whose words its own text has earlier, in the same megabyte, is a repeat already and goes no further.
1. Anchors. Of the 6-word sequences inside a suffix's words, the one with the smallest hash is its anchor. Suffixes with
   equal words have equal anchors, and neighbours mostly share one, so there is one row for each run of suffixes with a
   common anchor. Anchors that stand once in the corpus drop out: their suffixes cannot repeat. (A hash that two
   sequences share lets more through, never less.)
2. Groups. The rows that are left travel with their words to the group of their anchor. The prefix that names a group has
   a variable length: an anchor with over GROUP_ROWS rows is lengthened to all the words, and where that may still be
   too much, the group is split by a hash of the document into as many parts as its count asks for. The counts are exact,
   except for anchors with more than 1/4096 of all rows: those (4096 at most) are known from a sample of documents.
3. Trees. In each group the suffixes are sorted by their words. The common prefix of neighbours gives the internal nodes
   that are `words` deep; below each of them, all leaves but the earliest are repeats. A split group hands on the earliest
   leaf of each node, and these meet in one group more.

Words travel as 16-bit codes of a dictionary of frequent words, and as they are where it does not have them. The
dictionary and the sample only make rows shorter and groups smaller: results do not depend on them. Documents are
shuffled once, compressed; the joins with anchors and with repeats read the same shuffle files.

"Earlier" means a smaller id (null last), or the same document and an earlier start; rows with equal id count by a hash
of their text after that, and rows that are equal in both are one document and get the same answer. Texts that are null,
empty or shorter than the window lose nothing. An empty table gives an empty result. Ids are integers. A text of any
length is worked on in ranges of a megabyte, in one task.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from .words import Texts, mix, slices

PREFIX_WORDS = 6
#: Rows that a group holds about, and the share of all rows (one in so many) from which on an anchor's count is sampled.
GROUP_ROWS, HEAVY = 8192, 4096
#: Documents that are sampled about, words of the dictionary (the most frequent of the sample), and their bytes at most.
SAMPLE_DOCS, CODES, CODE_BYTES = 5000, 65_535, 16
_SLICE = 1 << 20
_GAP = re.compile(rb"\s")
_HEAVY_BIT = np.int64(1 << 31)
#: A place that no anchor has, heavy bit set: says that a text has repeats of its own, whatever becomes of its anchors.
_OWN = np.int64((1 << 32) - 1)
_ROWS = "key long, id long, h long, start int, n int, words binary"


def _leftmost_least(x: np.ndarray, width: int) -> np.ndarray:
    """Where the smallest of x[i : i + width] stands, the first of equal ones."""
    if len(x) < width:
        return np.zeros(0, dtype=np.int64)
    value, at, span = x, np.arange(len(x)), 1

    def joined(shift: int) -> None:
        nonlocal value, at
        if shift:
            less = value[shift:] < value[:-shift]
            value, at = np.where(less, value[shift:], value[:-shift]), np.where(less, at[shift:], at[:-shift])

    while span * 2 <= width:
        joined(span)
        span *= 2
    joined(width - span)
    return at


def _anchors(t: Texts, hashes: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all suffixes, each one's anchor (places among the batch's words), and the hash of each anchor's place."""
    grams, _ = t.grams(hashes, PREFIX_WORDS)
    s = np.flatnonzero(np.arange(len(hashes)) + words <= np.repeat(t.ptr[1:], t.counts))
    return s, _leftmost_least(grams, words - PREFIX_WORDS + 1)[s], grams


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before."""
    new = np.ones(len(columns[0]), dtype=bool)
    if len(new):
        new[1:] = False
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
    return new


def _runs(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and length of runs in which the last column goes up by one and the others stay."""
    n = len(columns[0])
    begin = np.flatnonzero(_changes(*columns[:-1], columns[-1] - np.arange(n)))
    return begin, np.diff(np.append(begin, n))


def _steps(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... for each size."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


class Dictionary:
    """16-bit codes (from 1) of frequent words; 0 stands for any other word."""

    def __init__(self, words: list[str]):
        each = sorted({w.encode() for w in words if 0 < len(w.encode()) <= CODE_BYTES})[:CODES]
        t = Texts(pa.array([w.decode() for w in each], pa.string()), np.ones(256, dtype=bool))
        h = t.hashes()
        order = np.argsort(h, kind="stable")
        self.hashes, self.codes = h[order], np.arange(1, len(each) + 1, dtype=np.uint16)
        self.bytes, self.sizes = self._padded(t, np.arange(len(each)))
        self.bytes, self.sizes = self.bytes[order], self.sizes[order]

    @staticmethod
    def _padded(t: Texts, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = (t.ends - t.starts)[at]
        data = np.concatenate([t.data, np.zeros(CODE_BYTES, np.uint8)])
        x = data[np.minimum(t.starts[at][:, None] + np.arange(CODE_BYTES), len(data) - 1)]
        x[np.arange(CODE_BYTES) >= size[:, None]] = 0
        return np.ascontiguousarray(x).view(np.uint64), size

    def of(self, t: Texts, hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Codes of the words at the places `at`; their bytes are compared, not only hashes."""
        out = np.zeros(len(at), dtype=np.uint16)
        if len(self.hashes) and len(at):
            near = np.minimum(np.searchsorted(self.hashes, hashes[at]), len(self.hashes) - 1)
            hit = np.flatnonzero(self.hashes[near] == hashes[at])
            x, size = self._padded(t, at[hit])
            near = near[hit]
            same = (size == self.sizes[near]) & (x == self.bytes[near]).all(axis=1)
            out[hit[same]] = self.codes[near[same]]
        return out


def _gather(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return data[np.repeat(starts, sizes) + _steps(sizes)]


def _binary(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())


def _coded(t: Texts, hashes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, codes: Dictionary) -> pa.Array:
    """`sizes` words from each of `starts` on: their codes, then those without a code, each with a space behind it."""
    at = np.repeat(starts, sizes) + _steps(sizes)
    code = codes.of(t, hashes, at)
    rare = np.flatnonzero(code == 0)
    of = np.repeat(np.arange(len(starts)), sizes)[rare]
    long = (t.ends - t.starts)[at[rare]] + 1
    tail = np.bincount(of, weights=long, minlength=len(starts)).astype(np.int64)
    whole = 2 * sizes + tail
    begin = np.cumsum(whole) - whole
    out = np.full(int(whole.sum()), 32, dtype=np.uint8)
    out[np.repeat(begin, 2 * sizes) + _steps(2 * sizes)] = code.view(np.uint8)
    before = np.cumsum(long) - long
    first = np.cumsum(tail) - tail
    place = (begin + 2 * sizes)[of] + before - first[of]
    out[np.repeat(place, long - 1) + _steps(long - 1)] = _gather(t.data, t.starts[at[rare]], long - 1)
    return _binary(out, whole)


def _decoded(column: pa.Array, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[list[bytes]]]:
    """Codes of all rows of _coded() one after the other, where each row's begin, and the words without a code."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    codes = np.ascontiguousarray(_gather(data, offsets[:-1], 2 * sizes)).view("<u2")
    rare = [data[a:b].tobytes().split(b" ")[:-1] if b > a else [] for a, b in zip((offsets[:-1] + 2 * sizes).tolist(), offsets[1:].tolist(), strict=True)]
    return codes, np.cumsum(sizes) - sizes, rare


def _ranges(text: bytes, words: int, size: int) -> Iterator[tuple[bytes, int, int]]:
    """Ranges of a long text: each one's bytes, with the words - 1 words behind it, its first word's place, and how many words
    start in it."""
    ahead = re.compile(rb"(?:\s*\S+){0,%d}" % (words - 1))  # \s of bytes: the six characters between words
    at = place = 0
    while at < len(text):
        cut = _GAP.search(text, at + size)
        end = cut.start() if cut else len(text)
        n = len(text[at:end].split())
        yield text[at : ahead.match(text, end).end()], place, n
        at, place = end, place + n


def _texts(column: list[str | None], words: int) -> Iterator[tuple[Texts, int, int]]:
    """The texts of a slice with 0 and a number that no place reaches; a long text, which is alone in its slice, in ranges."""
    if len(column) == 1 and len(column[0] or "") > 2 * _SLICE:
        for part, first, n in _ranges(column[0].encode(), words, _SLICE):
            yield Texts(pa.array([part], pa.binary())), first, n
    else:
        yield Texts(pa.array(column, pa.string())), 0, 1 << 40


def _places(t: Texts, h: np.ndarray, words: int, heavy: np.ndarray, first_place: int = 0, starts: int = 1 << 40) -> pa.RecordBatch:
    """One row for each anchor of each text: what it is counted by, and its document and place; and one for each text that
    repeats itself, which has to be read again even if no anchor of it stands elsewhere.

    A range of a text (see _ranges) begins at first_place and has so many starts; an anchor that two ranges share counts twice."""
    hashes = t.hashes()
    s, at, grams = _anchors(t, hashes, words)
    s, at = s[s < starts], at[s < starts]
    again = _own_repeats(t, s, t.rows()[s], t.grams(hashes, words)[0], words)
    own = h[np.unique(t.rows()[s[again]])] >> 32 << 32 | _OWN
    at = at[~again]
    a = at[_changes(at)]
    row = np.searchsorted(t.ptr, a, "right") - 1
    spot = (h[row] >> 32 << 32) | (a - t.ptr[row] + first_place)
    key = grams[a]
    known = np.isin(key, heavy)
    spot = np.where(known, spot | _HEAVY_BIT, spot)
    key = np.where(known, mix(spot.view(np.uint64)), key)
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([key, mix(own.view(np.uint64))]).view(np.int64)), pa.array(np.concatenate([spot, own]))], ["key", "spot"])


def _own_repeats(t: Texts, s: np.ndarray, row: np.ndarray, path: np.ndarray, words: int) -> np.ndarray:
    """Which of the suffixes s have words that an earlier one of the same text here has; words are compared, not only hashes."""
    with np.errstate(over="ignore"):
        _, first, of = np.unique(mix(path[s] + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True, return_inverse=True)
    first = first[of]
    out = np.zeros(len(s), dtype=bool)
    later = np.flatnonzero(first != np.arange(len(s)))
    if len(later):
        there = np.zeros(len(t.starts) + 1, dtype=np.int64)  # which words are compared: those of these suffixes and of their first ones
        for x in (s[later], s[np.unique(first[later])]):
            np.add.at(there, x, 1)
            np.add.at(there, x + words, -1)
        used = np.flatnonzero(np.cumsum(there)[:-1])
        word = np.zeros(len(t.starts), dtype=np.int32)
        word[used] = pa.array([t.word(i) for i in used], pa.binary()).dictionary_encode().indices.to_numpy()
        for lo in range(0, len(later), 1 << 16):
            i = later[lo : lo + (1 << 16)]
            a, b = s[i][:, None] + np.arange(words), s[first[i]][:, None] + np.arange(words)
            out[i] = (word[a] == word[b]).all(axis=1) & (row[i] == row[first[i]])
    return out


def _suffixes(t: Texts, ids: pa.Array, h: np.ndarray, spots: list[np.ndarray], words: int, heavy: tuple[np.ndarray, np.ndarray], codes: Dictionary, group_rows: int, first_place: int = 0, starts: int = 1 << 40) -> pa.RecordBatch:
    """The rows that travel to the groups, and repeats inside a text (words: null), which need no group.

    spots: of each text, anchors that repeat, and 2^32 times their count if it is large. first_place, starts: as in _places."""
    hashes = t.hashes()
    s, at, grams = _anchors(t, hashes, words)
    s, at = s[s < starts], at[s < starts]
    row = t.rows()[s]
    path, _ = t.grams(hashes, words)
    again = _own_repeats(t, s, row, path, words)
    r_begin, r_n = _runs(row[again], s[again])
    r_row, r_start = row[again][r_begin], s[again][r_begin] - t.ptr[row[again][r_begin]] + first_place
    s, at, row = s[~again], at[~again], row[~again]
    sizes = np.array([len(x) for x in spots], dtype=np.int64)
    flat = np.concatenate([np.zeros(0, np.int64), *spots])
    wanted = (np.repeat(np.arange(len(sizes)), sizes) << 32) | (flat & 0x7FFFFFFF)
    order = np.argsort(wanted, kind="stable")
    wanted, count = wanted[order], (flat >> 32)[order]
    own = (row << 32) | (at - t.ptr[row] + first_place)
    near = np.minimum(np.searchsorted(wanted, own), max(len(wanted) - 1, 0))
    stays = np.flatnonzero(wanted[near] == own) if len(wanted) else np.zeros(0, np.int64)
    s, at, row, count = s[stays], at[stays], row[stays], count[near[stays]] if len(wanted) else np.zeros(0, np.int64)
    key = grams[at]
    if len(heavy[0]):
        place = np.minimum(np.searchsorted(heavy[0], key), len(heavy[0]) - 1)
        count = np.where(heavy[0][place] == key, heavy[1][place], count)
    large = count > group_rows
    begin, n = _runs(row, at, np.where(large, np.arange(len(s)), -1), s)  # a lengthened prefix is one suffix's own
    large, first = large[begin], s[begin]
    if large.any():
        parts = -(-count[begin] // group_rows)
        part = mix(h[row[begin]].view(np.uint64)) % np.maximum(parts, 1).astype(np.uint64)
        with np.errstate(over="ignore"):
            own = mix(mix(path[first] + key[begin]) + part)
        key = np.where(large, own | np.uint64(1), key[begin] & ~np.uint64(1))
    else:
        key = key[begin] & ~np.uint64(1)
    r = pa.array(np.concatenate([row[begin], r_row]))
    start = np.concatenate([first - t.ptr[row[begin]] + first_place, r_start])
    with np.errstate(over="ignore"):
        key = np.concatenate([key, mix((h[r_row] + r_start).view(np.uint64)) & ~np.uint64(1)])
    texts = pa.concat_arrays([_coded(t, hashes, first, n + words - 1, codes), pa.nulls(len(r_n), pa.binary())])
    return pa.RecordBatch.from_arrays(
        [pa.array(key.view(np.int64)), ids.take(r), pa.array(h).take(r), pa.array(start.astype(np.int32)), pa.array(np.concatenate([n, r_n]).astype(np.int32)), texts],
        ["key", "id", "h", "start", "n", "words"],
    )


def _tree(rows: pa.Table, words: int) -> pa.RecordBatch:
    """Repeats (words: null), and the earliest leaves of nodes of split groups, for rows of whole groups."""
    rows = rows.combine_chunks()
    column = lambda c: rows[c].combine_chunks() if isinstance(rows[c], pa.ChunkedArray) else rows[c]
    n, group = rows["n"].to_numpy().astype(np.int64), column("key").to_numpy()
    codes, begin, rare = _decoded(column("words"), n + words - 1)
    of = np.repeat(np.arange(len(n)), n)
    j = _steps(n)
    first = begin[of] + j
    path = codes[first[:, None] + np.arange(words)]
    # words without a code tell suffixes with equal codes apart
    zeros = np.concatenate([[0], np.cumsum(codes == 0)])
    odd = np.flatnonzero(zeros[first + words] > zeros[first])
    other = np.zeros(len(of), dtype=np.int64)
    if len(odd):
        rank: dict[bytes, int] = {b"": 0}
        a, z = zeros[first[odd]] - zeros[begin[of[odd]]], zeros[first[odd] + words] - zeros[begin[of[odd]]]
        other[odd] = [rank.setdefault(b" ".join(rare[r][x:y]), len(rank)) for r, x, y in zip(of[odd].tolist(), a.tolist(), z.tolist(), strict=True)]
    wide = np.zeros((len(of), -(-words // 4) * 4), dtype=">u2")
    wide[:, :words] = path
    packed = wide.view(">u8").astype(np.uint64)
    null = np.asarray(column("id").is_null())[of]
    ids, h, start = column("id").fill_null(0).to_numpy()[of], column("h").to_numpy()[of], rows["start"].to_numpy()[of].astype(np.int64) + j
    order = np.lexsort((start, h, ids, null, other, *packed.T[::-1], group[of]))
    sorted_path = path[order]
    common = np.zeros(len(order), dtype=np.int64)  # words that a suffix and the one before it have in common from their start on
    if len(order):
        differ = sorted_path[1:] != sorted_path[:-1]
        common[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), words)
    node = (common < words) | _changes(group[of][order], other[order])
    if len(node):
        node[0] = True
    place = _changes(start[order], h[order], ids[order], null[order])
    head = np.maximum.accumulate(np.where(node, np.arange(len(order)), 0))
    # a leaf is a repeat if its place is not that of its node's first
    moved = np.cumsum(place & ~node)
    later = np.zeros(len(order), dtype=bool)
    later[order] = moved > moved[head]
    firsts = np.zeros(len(order), dtype=bool)
    firsts[order] = node
    hit = np.flatnonzero(later)
    at, size = _runs(of[hit], start[hit])
    repeats = hit[at]
    handed = np.flatnonzero(firsts & ((group[of] & 1) == 1))
    index = pa.array(of[np.concatenate([repeats, handed])])
    keys = mix((h[repeats] + start[repeats]).view(np.uint64))
    texts: list[bytes | None] = [None] * len(repeats)
    if len(handed):
        a, z = zeros[first[handed]] - zeros[begin[of[handed]]], zeros[first[handed] + words] - zeros[begin[of[handed]]]
        named = [p.tobytes() + b"".join(w + b" " for w in rare[r][x:y]) for p, r, x, y in zip(path[handed], of[handed].tolist(), a.tolist(), z.tolist(), strict=True)]
        texts += named
        keys = np.concatenate([keys, Texts(pa.array(named, pa.binary()), np.ones(256, dtype=bool)).hashes() & ~np.uint64(1)])
    return pa.RecordBatch.from_arrays(
        [pa.array(keys.view(np.int64)), column("id").take(index), column("h").take(index), pa.array(start[np.concatenate([repeats, handed])].astype(np.int32)), pa.array(np.concatenate([size, np.ones(len(handed), np.int64)]).astype(np.int32)), pa.array(texts, pa.binary())],
        ["key", "id", "h", "start", "n", "words"],
    )


def _trees(words: int):
    """mapInArrow function over rows that come sorted by key; known repeats (words: null) pass through."""

    most = 2_000_000 // words  # suffixes that are sorted at once, or one group

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # whole groups, but for the last one
        size = 0
        for b in batches:
            known = np.asarray(b.column("words").is_null())
            if known.any():
                yield b.filter(pa.array(known))
                b = b.filter(pa.array(~known))
            if not b.num_rows:
                continue
            for lo in range(0, b.num_rows, 2048):
                part = b.slice(lo, 2048)
                keys = part.column("key").to_numpy()
                size += int(part.column("n").to_numpy().sum())
                end = int(np.searchsorted(keys, keys[-1])) if size >= most else 0
                if end or held and size >= most and held[-1].column("key")[-1].as_py() != keys[0]:
                    yield _tree(pa.Table.from_batches([*held, part.slice(0, end)]), words)
                    part = part.slice(end)
                    held, size = [], int(part.column("n").to_numpy().sum())
                held.append(part)
        if held:
            yield _tree(pa.Table.from_batches(held), words)

    return run


def _kept(text: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """The words outside the spans of places, joined by one space, how many words there are, and how many stay."""
    starts, ends = (np.sort(np.array([s[k] for s in spans], dtype=np.int64)) for k in (0, 1))
    out, n, stay = [], 0, 0
    for part, first, size in _ranges(text, 1, _SLICE):
        w = part.split()
        place = np.arange(first, first + size)
        # a place is inside as many spans as have begun but not ended
        free = np.flatnonzero(np.searchsorted(starts, place, "right") == np.searchsorted(ends, place, "right"))
        if len(free):
            out.append(part if len(free) == size and part == b" ".join(w) else b" ".join([w[k] for k in free] if len(free) < size else w))
        n, stay = n + size, stay + len(free)
    return b" ".join(out), n, stay


def _dictionary(sample: DataFrame, text_col: str) -> Dictionary:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (s for b in batches for s in slices(b, "text", _SLICE)):
            n = Counter(w for t in b.column("text").to_pylist() for w in (t or "").encode().split() if len(w) <= CODE_BYTES)
            yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in n], pa.string()), pa.array(list(n.values()), pa.int64())], ["word", "n"])

    counted = sample.select(F.col(text_col).alias("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return Dictionary([r.word for r in counted.orderBy(F.col("n").desc(), "word").limit(CODES).collect()])


def _cut(docs: DataFrame, id_col: str, text_col: str, words: int, group_rows: int = GROUP_ROWS, share: int = HEAVY) -> DataFrame:
    """docs and __kept_text, __n_words, __n_removed; the names of docs don't begin with __."""
    if words < PREFIX_WORDS:
        raise ValueError(f"a window has {PREFIX_WORDS} words at least")
    spark, names = docs.sparkSession, docs.columns
    id_ = F.col(f"`{id_col}`").cast("long")
    plain = docs.select(*[F.col(f"`{c}`") for c in names], id_.alias("__id"), F.xxhash64(id_, F.col(f"`{text_col}`")).alias("__h"))
    texts = plain.select("__h", F.col(f"`{text_col}`").alias("__text"))
    every = max(1, docs.count() // SAMPLE_DOCS)
    sample = texts.where(F.pmod(F.xxhash64("__h"), F.lit(every)) == 0)

    def places(heavy):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in (s for b in batches for s in slices(b, "__text", _SLICE)):
                for t, first, starts in _texts(b.column("__text").to_pylist(), words):
                    yield _places(t, b.column("__h").to_numpy(), words, heavy.value[0] if heavy else np.zeros(0, np.uint64), first, starts)

        return run

    counts = sample.mapInArrow(places(None), "key long, spot long").groupBy("key").agg(F.count("*").alias("c"))
    # an anchor with 1/share of the sampled rows: `share` of them at most, whatever the size of the table
    total = counts.agg(F.sum("c").alias("total"))
    found = counts.join(F.broadcast(total)).where((F.col("c") * share >= F.col("total")) & (F.col("c") > 1)).select("key", "c").collect()
    known = np.array(sorted((r.key % (1 << 64), r.c * every) for r in found), dtype=np.uint64).reshape(-1, 2)
    heavy = spark.sparkContext.broadcast((known[:, 0], known[:, 1].astype(np.int64)))
    codes = spark.sparkContext.broadcast(_dictionary(sample, "__text"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3)
        at = names.index(text_col)
        for b in batches:
            h = b.column("__h").to_numpy()
            raw = [None if t is None else t.encode() for t in b.column(at).to_pylist()]
            sizes, text = [len(t or b"") for t in raw], pa.array([None if t is None else z.compress(t) for t in raw], pa.binary())
            yield pa.RecordBatch.from_arrays([*[text if i == at else b.column(i) for i in range(len(names))], b.column("__id"), b.column("__h"), pa.array((h >> 32).astype(np.int32)), pa.array(sizes, pa.int64())], [*b.schema.names, "__k", "__size"])

    fields = [StructField(f.name, BinaryType() if f.name == text_col else f.dataType) for f in docs.schema.fields]
    schema = StructType([*fields, StructField("__id", LongType()), StructField("__h", LongType(), False), StructField("__k", IntegerType(), False), StructField("__size", LongType())])
    base = plain.mapInArrow(packed, schema)

    everywhere = texts.mapInArrow(places(heavy), "key long, spot long")
    twice = everywhere.withColumn("c", F.expr("count(*) OVER (PARTITION BY key)")).where((F.col("c") > 1) | (F.col("spot").bitwiseAND(F.lit(int(_HEAVY_BIT))) != 0))
    spot = F.when(F.col("c") > group_rows, F.shiftleft(F.least("c", F.lit((1 << 31) - 1)), 32)).otherwise(F.lit(0).cast("long"))
    spots = twice.select(F.shiftright("spot", 32).cast("int").alias("__k"), F.col("spot").bitwiseAND(F.lit(0x7FFFFFFF)).bitwiseOR(spot).alias("s")).groupBy("__k").agg(F.collect_set("s").alias("__spots"))

    def unpacked(column: pa.Array) -> list[str | None]:
        z = zstandard.ZstdDecompressor()
        return [None if x is None else z.decompress(x).decode() for x in column.to_pylist()]

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (s for b in batches for s in slices(b, "__size", _SLICE)):
            b = b.take(pa.array(np.unique(b.column("__h").to_numpy(), return_index=True)[1]))  # repeated rows are one document
            lists = b.column("__spots")
            flat, ends = lists.flatten().to_numpy(), np.cumsum([0, *(pa.compute.list_value_length(lists).to_numpy())])
            each = [flat[a:z] for a, z in zip(ends[:-1], ends[1:], strict=True)]
            for t, first, starts in _texts(unpacked(b.column(text_col)), words):
                yield _suffixes(t, b.column("__id"), b.column("__h").to_numpy(), each, words, heavy.value, codes.value, group_rows, first, starts)

    rows = base.join(spots, "__k").mapInArrow(suffixes, _ROWS)
    for _ in range(2):  # groups, then the earliest leaves that split groups hand on
        rows = rows.repartition("key").sortWithinPartitions("key").mapInArrow(_trees(words), _ROWS)
    found = rows.where("words IS NULL").select(F.shiftright("h", 32).cast("int").alias("__k"), F.struct("id", "h", "start", "n").alias("r")).groupBy("__k").agg(F.collect_set("r").alias("__runs"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (s for b in batches for s in slices(b, "__size", _SLICE)):
            text, kept, sizes, lost = unpacked(b.column(text_col)), [], [], []
            for t, i, h, runs in zip(text, b.column("__id").to_pylist(), b.column("__h").to_pylist(), b.column("__runs").to_pylist(), strict=True):
                left, n, stay = _kept((t or "").encode(), [(r["start"], r["start"] + r["n"] + words - 1) for r in runs or [] if r["id"] == i and r["h"] == h])
                kept.append(left.decode())
                sizes.append(n)
                lost.append(n - stay)
            old = [pa.array(text, pa.string()) if c == text_col else b.column(k) for k, c in enumerate(b.schema.names) if c not in ("__k", "__id", "__h", "__size", "__runs")]
            yield pa.RecordBatch.from_arrays([*old, pa.array(kept, pa.string()), pa.array(sizes, pa.int64()), pa.array(lost, pa.int64())], [*names, "__kept_text", "__n_words", "__n_removed"])

    joined = base.join(found, "__k", "left").select("__k", *[F.col(f"`{c}`") for c in names], "__id", "__h", "__size", "__runs")
    out = StructType([*docs.schema.fields, *StructType.fromDDL("__kept_text string, __n_words long, __n_removed long").fields])
    return joined.mapInArrow(cut, out)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 20) -> DataFrame:
    """The columns of docs, and kept_text (words that stay, joined by one space), n_words, n_removed; columns of these
    three names are replaced."""
    new = ("kept_text", "n_words", "n_removed")
    x, id_, text = _plainly(docs, id_col, text_col)
    stay = [(k, c) for k, c in enumerate(docs.columns) if c not in new]
    return _cut(x, id_, text, words).select(*[f"c{k}" for k, _ in stay], *[f"__{c}" for c in new]).toDF(*[c for _, c in stay], *new)


def with_repeats_cut(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 50, length_col: str | None = None) -> DataFrame:
    """The columns of docs alone: a text that loses words is its remaining words, joined by one space, and length_col
    their characters; a text that loses none stays as it is."""
    x, id_, text = _plainly(docs, id_col, text_col)
    hit = F.col("__n_removed") > 0
    new = {text: F.when(hit, F.col("__kept_text")).otherwise(F.col(text))}
    if length_col:
        size = f"c{docs.columns.index(length_col)}"
        new[size] = F.when(hit, F.length("__kept_text").cast(docs.schema[length_col].dataType)).otherwise(F.col(size))
    return _cut(x, id_, text, words).select(*[new.get(c, F.col(c)) for c in x.columns]).toDF(*docs.columns)


def _plainly(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str, str]:
    """docs with columns c0, c1, ..., so that none clashes with a name of ours, and those of the id and the text."""
    return docs.toDF(*[f"c{k}" for k in range(len(docs.columns))]), f"c{docs.columns.index(id_col)}", f"c{docs.columns.index(text_col)}"
