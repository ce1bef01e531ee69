"""Exact token counts of every prefix of a text, by dynamic programming.

BPE gives each prefix of a word a last token: the one token that ends there and stands in a stable pair with the last
token of the prefix before it. So count[i] = count[i - length of that token] + 1, and one pass over a word counts all
its prefixes; a text's prefixes follow from its words. The table of a text is stored as the differences of the counts
from one character to the next, zigzag varints of one byte almost always. Questions (tokens in all, longest prefix
within a budget, tokens of a prefix) are answered from the table without encoding again.

Special strings inside a text count as the library's default has it: as one token once complete, as ordinary text
while a prefix ends inside. Null texts count as empty: 0 bytes, 0 tokens, an empty table. Repeated rows are each
answered; a table without rows gives none; a text of any length is taken whole; other columns are left aside.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import _DIGIT, _LATIN, PLAIN, library
from .words import slices

#: Words whose tables a worker holds (about 500 bytes each, with their prefixes); beyond that it starts anew.
CACHED_WORDS = 400_000
_PLAIN_WORDS = f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LATIN}]+| ?[{_DIGIT}]+| ?[^\\s{_LATIN}{_DIGIT}]+|\\s+(?!\\S)|\\s+"


def varints(deltas: list[int]) -> bytes:
    if all(-64 <= d < 64 for d in deltas):
        return bytes([d << 1 if d >= 0 else (-d << 1) - 1 for d in deltas])
    out = bytearray()
    for d in deltas:
        z = d << 1 if d >= 0 else (-d << 1) - 1
        while z > 127:
            out.append(z & 127 | 128)
            z >>= 7
        out.append(z)
    return bytes(out)


def prefix_counts(table: bytes) -> np.ndarray:
    """Token counts of the prefixes of 1, 2, ... characters."""
    x = np.frombuffer(table, dtype=np.uint8)
    if len(x) and x.max() > 127:
        ends = np.flatnonzero(x < 128)
        begin = np.concatenate([[0], ends[:-1] + 1])
        shift = 7 * (np.arange(len(x)) - np.repeat(begin, ends - begin + 1))
        x = np.add.reduceat((x & 127).astype(np.int64) << shift, begin)
    x = x.astype(np.int64)
    return np.cumsum((x >> 1) ^ -(x & 1))


class PrefixCounter:
    """Byte-level BPE from a tokenizers file whose pre-tokenizer is the usual byte-level split."""

    def __init__(self, path: str):
        self.lib = library(path)
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        pre, model = file["pre_tokenizer"], file["model"]
        if file["normalizer"] or pre["type"] != "ByteLevel" or not pre["use_regex"] or pre["add_prefix_space"] or model["ignore_merges"]:
            raise ValueError(f"not a plain byte-level BPE file: {path}")
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
        raw = lambda token: bytes(byte_of[c] for c in token)
        self.ids = {raw(t): i for t, i in model["vocab"].items()}
        self.tokens = {i: t for t, i in self.ids.items()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.rank = {(raw(a), raw(b)): k for k, (a, b) in enumerate(merges)}
        self.special = [x["content"] for x in file["added_tokens"]]
        self.longest = max(map(len, self.ids))
        self.ends: dict[bytes, list[int]] = {}
        for t in self.ids:
            self.ends.setdefault(t[-2:], []).append(len(t))
        self.ends = {k: sorted({1, *v}, reverse=True) for k, v in self.ends.items()}
        self.plain, self.split = re.compile(f"[{PLAIN}]*").fullmatch, re.compile(_PLAIN_WORDS).findall
        self.spines: tuple[dict, dict] = ({}, {})
        self.stable: dict[tuple[bytes, bytes], bool] = {}
        self.states: dict[bytes, tuple[bytes, int]] = {}
        self.cache: dict[str, bytes] = {}
        self.seen: dict[bytes, bytes] = {}

    def _merges(self, word: bytes) -> list[tuple[bytes, bytes]]:
        """The merges that plain BPE makes in a few bytes, in order."""
        parts, made = [word[i : i + 1] for i in range(len(word))], []
        while len(parts) > 1:
            ranks = [self.rank.get(x, 1 << 60) for x in zip(parts, parts[1:])]
            at = ranks.index(min(ranks))
            if ranks[at] == 1 << 60:
                break
            made.append((parts[at], parts[at + 1]))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return made

    def _spine(self, token: bytes, side: int) -> list[tuple[bytes, float]] | None:
        """The parts of a token at its right (1) or left (0) edge, smallest first, each with the rank of the merge that
        takes it up; None if BPE does not make this token of its own bytes."""
        spine = self.spines[side].get(token, 0)
        if spine == 0:
            of = {a + b: (a, b) for a, b in self._merges(token)}
            spine, part, above = [], token, float("inf")
            if len(token) > 1 and token not in of:
                spine = None
            while spine is not None:
                spine.append((part, above))
                if len(part) == 1:
                    spine.reverse()
                    break
                above = self.rank[of[part]]
                part = of[part][side]
            self.spines[side][token] = spine
        return spine

    def _pair(self, a: bytes, b: bytes) -> bool:
        """Whether BPE leaves the tokens a and b side by side as they are: no merge across them comes before those that
        take their edges up."""
        if len(self.stable) > 500_000:
            self.stable.clear()
        left, right = self._spine(a, 1) if a else [(b"", float("inf"))], self._spine(b, 0)
        ok, i, j = left is not None and right is not None, 0, 0
        while ok:
            (x, up), (y, over) = left[i], right[j]
            across = self.rank.get((x, y), float("inf"))
            if across < up and across <= over:
                ok = False
            elif up == over == float("inf"):
                break
            elif up <= over:
                i += 1
            else:
                j += 1
        self.stable[a, b] = ok
        return ok

    def byte_counts(self, word: bytes) -> list[int]:
        """counts[i]: tokens of the first i bytes of a word."""
        ids, ends, stable, states = self.ids, self.ends, self.stable, self.states
        size = len(word)
        known = min(size, 16)
        while known and word[:known] not in states:
            known -= 1
        last, counts = [b""], [0]
        for i in range(1, known + 1):
            t, n = states[word[:i]]
            last.append(t)
            counts.append(n)
        for i in range(known + 1, size + 1):
            for n in ends.get(word[i - 2 : i], (1,)) if i > 1 else (1,):
                if n <= i:
                    t = word[i - n : i]
                    if t in ids:
                        ok = stable.get((last[i - n], t))
                        if ok or ok is None and self._pair(last[i - n], t):
                            break
            else:
                raise ValueError(f"no token ends here: {word!r}")
            last.append(t)
            counts.append(counts[i - n] + 1)
            if i <= 16:
                states[word[:i]] = (t, counts[i])
        return counts

    def word_counts(self, word: str) -> list[int]:
        """counts[i]: tokens of the first i characters of a word that stands alone."""
        raw = word.encode()
        counts = self.byte_counts(raw)
        if len(raw) != len(word):
            at, n = [0], 0
            for c in word:
                n += len(c.encode())
                at.append(n)
            counts = [counts[i] for i in at]
        if word[0] == "'" and len(word) > 1 and word[1].isalpha():  # a contraction: the quote alone, then letters
            for i in range(2, len(word)):
                counts[i] = 1 + self.byte_counts(word[1:i].encode())[-1]
        return counts

    def _table(self, word: str) -> bytes:
        table = self.cache.get(word)
        if table is None:
            counts = self.word_counts(word)
            table = varints([b - a for a, b in zip(counts, counts[1:])])
            table = self.seen.setdefault(table, table)
            self.cache[word] = table
        return table

    def _words(self, text: str) -> list[str]:
        if self.plain(text):
            return self.split(text)
        return [text[a:b] for _, (a, b) in self.lib.pre_tokenizer.pre_tokenize_str(text)]

    def table(self, text: str) -> bytes:
        """The whole text's differences."""
        if len(self.cache) > CACHED_WORDS:
            self.cache.clear()
            self.states.clear()
            self.seen.clear()
        if not any(s in text for s in self.special):
            return self._segment(text)
        out, at, pattern = [], 0, re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))))
        for m in pattern.finditer(text):
            words = self._words(text[at : m.start()])
            before = self._count(words)
            tail = words[-1] if words else ""
            base = before - (self._count([tail]) if tail else 0)
            counts = [before]
            for i in range(1, len(m[0])):
                counts.append(base + self._count(self._words(tail + m[0][:i])))
            counts.append(before + 1)
            out += [self._segment(text[at : m.start()]), varints([b - a for a, b in zip(counts, counts[1:])])]
            at = m.end()
        return b"".join([*out, self._segment(text[at:])])

    def _count(self, words: list[str]) -> int:
        return sum(int(prefix_counts(self._table(w))[-1]) for w in words)

    def _segment(self, text: str) -> bytes:
        words = self._words(text)
        get = self.cache.get
        tables = [get(w) or self._table(w) for w in words]
        if "  " in text or not _one_space(text):
            self._white_space(words, tables)
        return b"".join(tables)

    def _white_space(self, words: list[str], tables: list[bytes]) -> None:
        """A prefix that ends after a run of white space takes the run as one word; its last one belongs to the next word only once that goes on."""
        for i in range(1, len(words)):
            run, word = words[i - 1], words[i]
            if all(map(_is_space, run)) and _is_space(word[0]):
                together = self.word_counts(run + word[0])[-1] - self.word_counts(run)[-1]
                counts = self.word_counts(word)
                alone, counts[1] = counts[1], together
                tables[i] = varints([b - a for a, b in zip(counts, counts[1:])])
                if len(word) == 1 and i + 1 < len(words):
                    after = self.word_counts(words[i + 1])
                    tables[i + 1] = varints([b - a for a, b in zip([together - alone, *after[1:]], after[1:])])


def _is_space(c: str) -> bool:
    """White space as the split pattern has it; Python alone counts the four separators too."""
    return c.isspace() and not "\x1c" <= c <= "\x1f"


_one_space = re.compile(r"\s?(?:\S+\s)*\S*").fullmatch


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    """One for each Python worker and file."""
    return PrefixCounter(path)


SCHEMA = "n_bytes long, n_tokens long, fits long, prefix_table binary"


def token_counts(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, fits (characters of the longest prefix of at most `limit` tokens) and prefix_table."""
    x = docs.selectExpr(f"`{id_col}` AS doc_id", f"coalesce(`{text_col}`, '') AS text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for b in (s for b in batches for s in slices(b, "text", 1 << 20)):
            tables = [c.table(t) for t in b.column("text").to_pylist()]
            tokens, fits = [], []
            for t in tables:
                counts = prefix_counts(t)
                tokens.append(int(counts[-1]) if len(counts) else 0)
                fits.append(int(np.flatnonzero(counts <= limit)[-1]) + 1 if len(counts) and counts.min() <= limit else 0)
            sizes = pa.compute.binary_length(b.column("text")).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), sizes, pa.array(tokens, pa.int64()), pa.array(fits, pa.int64()), pa.array(tables, pa.binary())], ["doc_id", "n_bytes", "n_tokens", "fits", "prefix_table"])

    return x.mapInArrow(run, f"doc_id {x.schema['doc_id'].dataType.simpleString()}, {SCHEMA}")
