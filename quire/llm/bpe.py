"""BPE encoding and decoding of whole texts, exactly as the tokenizers library gives them.

Texts up to `leaf_chars` are encoded where they stand. A longer text is halved until every leaf is short enough, the
leaves are encoded in parallel on any executor, and neighbours are joined in a tree: around each join a growing window
of the text is encoded again until it agrees with both sides, that is, until some token of the left half and some
token of the right half come out of the window at the same places. BPE chooses a token sequence whose neighbouring
pairs are each stable, so a shared token lets the sequences be spliced there. A window that has grown over the whole
text is the plain encoding, so the result never depends on the cut.

Null texts count as empty and give no tokens and an empty text. Repeated rows are each answered; long texts are keyed
by their SHA-256, so null or repeated ids do not matter. An empty table gives an empty result. Other columns are left aside.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import joined_back
from .durable import checkpointed
from .words import slices

#: Characters of which Python and the library agree on case, class and normal form.
PLAIN = "\t\n\r\x20-\x7e\xa1-\xffŒœ–-…"
_LATIN = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xffŒœ"
_DIGIT = "0-9\xb2\xb3\xb9\xbc-\xbe"
#: Split patterns of tokenizer files whose words can be cached, and the same for plain characters alone.
SPLITS = {
    "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+": f"'s|'t|'re|'ve|'m|'ll|'d|[{_LATIN}]+|[{_DIGIT}]|[^\\s{_LATIN}{_DIGIT}]+",
}
LEAF_CHARS = 1 << 15
CACHED_WORDS = 100_000
#: Copies of one long text that a task answers about.
COPIES = 1024


def library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class Encoder:
    """One tokenizer file with a bounded cache of whole words."""

    def __init__(self, path: str):
        import json

        self.lib = library(path)
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        steps = (file["pre_tokenizer"] or {}).get("pretokenizers", [])
        split = next((SPLITS.get(x["pattern"].get("Regex", "")) for x in steps if x["type"] == "Split" and x["invert"] and x["behavior"] == "Removed"), None)
        normal = [x["type"] for x in (file["normalizer"] or {}).get("normalizers", [])]
        self.words = re.compile(split).findall if split and normal == ["NFC", "Replace", "Lowercase"] else None
        self.plain = re.compile(f"[{PLAIN}]*").fullmatch
        self.special = [x["content"] for x in file["added_tokens"]]
        self.guard = 1 + max([16, *map(len, self.special)])  # a special string near a window's edge may be cut by it
        self.join = file["decoder"] is None
        self.cache: dict[str, bytes] = {}
        self.vocabulary = np.array([self.lib.id_to_token(i) for i in range(self.lib.get_vocab_size())], dtype=object)

    def _learn(self, words: list[str]) -> None:
        """Words that are not cached, encoded in one go; a white space keeps them apart."""
        for i in range(0, len(words), 5000):
            part = words[i : i + 5000]
            e = self.lib.encode(" ".join(part), add_special_tokens=False)
            ids, of = np.array(e.ids, dtype="<u4"), np.array(e.offsets)[:, 0]
            begins = np.cumsum([0] + [len(w) + 1 for w in part])
            ptr = np.searchsorted(of, begins)
            for k, w in enumerate(part):
                self.cache[w] = ids[ptr[k] : ptr[k + 1]].tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        out: list[bytes] = [b""] * len(texts)
        rest, split = [], {}
        for i, t in enumerate(texts):
            if self.words and self.plain(t) and not any(s in t for s in self.special):
                split[i] = self.words(t.lower())
            else:
                rest.append(i)
        if len(self.cache) > CACHED_WORDS:
            self.cache.clear()
        unknown = {w for words in split.values() for w in words}
        self._learn([w for w in unknown if w not in self.cache])
        get = self.cache.__getitem__
        for i, words in split.items():
            out[i] = b"".join(map(get, words))
        for i, e in zip(rest, self.lib.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, dtype="<u4").tobytes()
        return out

    def decode(self, ids: bytes) -> str:
        """The library's decode(ids, skip_special_tokens=False); without a decoder it joins the tokens by a space."""
        x = np.frombuffer(ids, dtype="<u4")
        return " ".join(self.vocabulary[x].tolist()) if self.join else self.lib.decode(x.tolist(), skip_special_tokens=False)

    def spans(self, text: str) -> np.ndarray:
        """Rows (start, end, id) of a text's tokens."""
        e = self.lib.encode(text, add_special_tokens=False)
        return np.column_stack([np.array(e.offsets, dtype=np.int64).reshape(-1, 2), np.array(e.ids, dtype=np.int64)])

    def concatenate(self, text: str, leaves: list[tuple[int, int, np.ndarray]]) -> np.ndarray:
        """leaves: (start, end, spans in the text) of its parts in order; the spans of the whole text."""
        while len(leaves) > 1:
            paired = [self._join(text, *leaves[i : i + 2]) for i in range(0, len(leaves) - 1, 2)]
            leaves = paired + leaves[len(paired) * 2 :]
        return leaves[0][2]

    def _join(self, text: str, a: tuple[int, int, np.ndarray], b: tuple[int, int, np.ndarray], window: int = 64) -> tuple[int, int, np.ndarray]:
        (lo, cut, left), (_, hi, right) = a, b
        while True:
            start, end = max(lo, cut - window), min(hi, cut + window)
            middle = self.spans(text[start:end]) + [start, start, 0]
            if (start, end) == (lo, hi):
                return lo, hi, middle
            i = 0 if start == lo else _shared(left, middle, start + self.guard, cut)
            j = 0 if end == hi else _shared(right, middle, cut, end - self.guard)
            if i is not None and j is not None:
                from_left = left[:0] if start == lo else left[: int(np.searchsorted(left[:, 0], i))]
                first = 0 if start == lo else int(np.searchsorted(middle[:, 0], i))
                last = len(middle) if end == hi else int(np.searchsorted(middle[:, 0], j))
                if first <= last:
                    rest = right[:0] if end == hi else right[int(np.searchsorted(right[:, 0], j)) :]
                    return lo, hi, np.concatenate([from_left, middle[first:last], rest])
            window *= 2


def _clean(x: np.ndarray) -> np.ndarray:
    """Which tokens have their characters to themselves."""
    ok = x[:, 0] < x[:, 1]
    ok[1:] &= x[:-1, 1] <= x[1:, 0]
    ok[:-1] &= x[:-1, 1] <= x[1:, 0]
    return ok


def _shared(side: np.ndarray, window: np.ndarray, start: int, end: int) -> int | None:
    """Where a token begins that both have between start and end; the middle one, away from either cut.

    Two tokens in a row must agree, so that neither side's cut decides how the first one began."""
    s = side[(side[:, 0] >= start) & (side[:, 1] <= end)]
    w = window[(window[:, 0] >= start) & (window[:, 1] <= end)]
    if len(s) < 2 or len(w) < 2:
        return None
    s_ok, w_ok = _clean(s), _clean(w)
    known = {(*a, *b) for a, b, x, y in zip(s[:-1].tolist(), s[1:].tolist(), s_ok[:-1], s_ok[1:], strict=True) if x and y}
    at = [a[0] for a, b, x, y in zip(w[:-1].tolist(), w[1:].tolist(), w_ok[:-1], w_ok[1:], strict=True) if x and y and (*a, *b) in known]
    return at[len(at) // 2] if at else None


def halves(start: int, end: int, most: int) -> list[tuple[int, int]]:
    """Leaves of the halving of [start, end), left to right."""
    if end - start <= most:
        return [(start, end)]
    middle = (start + end) // 2
    return halves(start, middle, most) + halves(middle, end, most)


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One for each Python worker and file."""
    return Encoder(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", leaf_chars: int = LEAF_CHARS, decoded: bool = False) -> DataFrame:
    """doc_id and ids: binary, little-endian unsigned 32-bit integers; if asked, also what they decode to, in the same pass."""
    x = docs.selectExpr(f"`{id_col}` AS doc_id", f"coalesce(`{text_col}`, '') AS text")

    more, named = (", decoded string", ["decoded"]) if decoded else ("", [])

    def answered(keys: pa.Array, key: str, ids: list[bytes]) -> pa.RecordBatch:
        texts = [pa.array([encoder(path).decode(x) for x in ids], pa.string())] if decoded else []
        return pa.RecordBatch.from_arrays([keys, pa.array(ids, pa.binary()), *texts], [key, "ids", *named])

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (s for b in batches for s in slices(b, "text", 1 << 20)):
            yield answered(b.column("doc_id"), "doc_id", encoder(path).encode(b.column("text").to_pylist()))

    kind = x.schema["doc_id"].dataType.simpleString()
    done = x.where(F.length("text") <= leaf_chars).mapInArrow(short, f"doc_id {kind}, ids binary{more}")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, text in zip(b.column("key").to_pylist(), b.column("text").to_pylist(), strict=True):
                parts = halves(0, len(text), leaf_chars)
                yield pa.RecordBatch.from_pydict({"key": [key] * len(parts), "start": pa.array([s for s, _ in parts], pa.int32()), "part": [text[s:e] for s, e in parts]})

    def leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (s for b in batches for s in slices(b, "part", 1 << 20)):
            spans = [encoder(path).spans(t).astype("<i8").tobytes() for t in b.column("part").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(spans, pa.binary())], ["key", "start", "part", "spans"])

    def tree(table: pa.Table) -> pa.Table:
        table = table.sort_by("start")
        parts, starts = table["part"].to_pylist(), table["start"].to_pylist()
        spans = [np.frombuffer(x, dtype="<i8").reshape(-1, 3) + [s, s, 0] for x, s in zip(table["spans"].to_pylist(), starts, strict=True)]
        leaves = [(s, s + len(p), x) for s, p, x in zip(starts, parts, spans, strict=True)]
        ids = encoder(path).concatenate("".join(parts), leaves)[:, 2].astype("<u4").tobytes()
        return pa.Table.from_batches([answered(table["key"].slice(0, 1).combine_chunks(), "key", [ids])])

    long = x.where(F.length("text") > leaf_chars).withColumn("key", F.sha2("text", 256))
    leaves = long.dropDuplicates(["key"]).select("key", "text").mapInArrow(cut, "key string, start int, part string")
    # leaves are few bytes and much work: they are dealt to a fixed number of tasks, which their bytes would not ask for
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = leaves.repartition(parts, "key", "start").mapInArrow(leaf, "key string, start int, part string, spans binary").groupBy("key").applyInArrow(tree, f"key string, ids binary{more}")
    # a text with many copies is answered in as many places as their number asks for
    named_by = checkpointed(long.select("doc_id", "key"))
    counts = named_by.groupBy("key").agg(F.count("*").alias("k"))
    salts = F.ceil(F.col("k") / COPIES).cast("int")
    asked = joined_back(named_by, counts, "key").select("doc_id", "key", F.pmod(F.xxhash64("doc_id"), salts).cast("int").alias("salt"))
    answers = whole.join(counts, "key").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("k")
    return done.unionByName(asked.join(answers, ["key", "salt"]).select("doc_id", "ids", *named))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Adds `decoded` to rows of doc_id and ids; null ids count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (s for b in batches for s in slices(b, "ids", 1 << 20)):
            text = [encoder(path).decode(x or b"") for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("ids"), pa.array(text, pa.string())], ["doc_id", "ids", "decoded"])

    x = encoded.select("doc_id", "ids")
    return x.mapInArrow(run, f"doc_id {x.schema['doc_id'].dataType.simpleString()}, ids binary, decoded string")
