"""Phrase collocation mining: phrases whose words meet more often than their parts let expect, for each language.

n-grams of 1, 2, ... words are exploded into rows, and hash-aggregated per language. A phrase that occurs `least` times has
parts that do, so longer n-grams are exploded only where all their parts of a shorter length may have come that far. First
they are exploded as 64-bit keys of language and words, length after length; a Bloom filter of the keys that come `least` times
tells for the next length. A last pass explodes those that may be frequent as texts, of all lengths, and counts them by text.
Keys that collide and what a filter lets through by mistake cost a row and are left out by that count, so counts are whole and
exact for every phrase that reaches `least`, however full a filter of bounded size is. Frequent phrases then meet the counts
of their prefixes and suffixes by joins, are scored in decimals, lose those that a phrase of one word more accounts for by an
anti-join, and are ranked.

Pieces and words: A-Z in lower case; texts end at `[.,;:!?\\x0A-\\x0D]`, words at space and tab. A null text has no words,
a null language is `und`. Rows that are repeated count again. A very long text is taken in blocks of about a megabyte that
look four words ahead, whatever its pieces are. Hot languages and phrases are added up in each batch and task before they
are shuffled, and ranks are limited in each task first. An empty table gives an empty result. Other columns are left aside
and may have any name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .durable import checkpointed
from .words import Texts, byte_table, mix, slices

#: Bytes that end a piece, and those that end a word inside one.
BREAKS, GAPS = b".,;:!?\n\v\f\r", b" \t"
_WORD_BYTES = byte_table(BREAKS + GAPS)
_IS_BREAK = ~byte_table(BREAKS)
_END = re.compile(rb"[ \t.,;:!?\n-\r]")
#: Bytes of text that are worked on at once.
BLOCK_BYTES = 1 << 20
#: Bits of the filter for each frequent phrase, about, and log2 of the most it can have (32 MiB).
BITS_EACH, MOST_BITS = 24, 28
#: Keys that are counted together in a task before they are put out, and lengths that have a pass of their own.
KEYS_HELD, ALONE = 1 << 20, 3
#: Groups in which a language's phrases are ranked first.
GROUPS = 32


def blocks(text: bytes, words: int, size: int = BLOCK_BYTES) -> Iterator[tuple[bytes, int]]:
    """(block, limit): the n-grams of up to `words` words of a text are those that start before the limit of a block."""
    ahead = re.compile(rb"(?:[ \t]*[^ \t.,;:!?\n-\r]+){0,%d}" % (words - 1))
    at = 0
    while True:
        cut = _END.search(text, at + size)
        if cut is None:
            yield text[at:], len(text) - at
            return
        yield text[at : ahead.match(text, cut.start()).end()], cut.start() - at
        at = cut.start()


class Grams:
    """The n-grams of a column of texts (UTF-8): n-gram i starts with word i."""

    def __init__(self, column: pa.Array, limits: np.ndarray, langs: np.ndarray):
        t = Texts(column, _WORD_BYTES, lower=True)
        self.words, rows = t, t.rows()
        self.piece = np.cumsum(_IS_BREAK[t.data])[t.starts] if len(t.starts) else np.zeros(0, np.int64)
        self.starts_here = t.starts - t.offsets[rows] < limits[rows]
        self.lang_keys = langs[rows]
        self.hashes = t.hashes()
        # words with one space after each
        self.sizes = t.ends - t.starts + 1
        self.at = np.concatenate([[0], np.cumsum(self.sizes)])
        self.spaced = np.full(self.at[-1], 32, dtype=np.uint8)
        self.spaced[_spans(self.at[:-1], self.sizes - 1)] = t.data[_spans(t.starts, self.sizes - 1)]

    def keys(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """A hash of (language, n words from each word on), and whether they stand in one piece."""
        if not len(self.hashes):
            return self.hashes, np.zeros(0, bool)
        h, whole = self.words.grams(self.hashes, n)
        last = np.minimum(np.arange(len(h)) + n - 1, len(h) - 1)
        return mix(h ^ self.lang_keys), whole & (self.piece[last] == self.piece)

    def phrases(self, n: int, which: np.ndarray) -> pa.Array:
        """The texts of the n-grams at the given words."""
        sizes = self.at[which + n] - self.at[which] - 1
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        return pa.LargeStringArray.from_buffers(len(which), pa.py_buffer(offsets), pa.py_buffer(self.spaced[_spans(self.at[which], sizes)]))


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each span, one after the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - sizes), sizes)


def _places(keys: np.ndarray, log_bits: int) -> list[np.ndarray]:
    """Two bits of the filter for each key."""
    low = np.uint64((1 << log_bits) - 1)
    return [keys & low, (keys >> np.uint64(64 - log_bits)) & low]


def _parts_of(batch: pa.RecordBatch, words: int) -> Iterator[tuple[Grams, pa.Array]]:
    """n-grams and the language of each word, for about BLOCK_BYTES of text at a time."""
    for b in slices(batch, "text", BLOCK_BYTES):
        texts, langs = b.column("text"), b.column("lang").dictionary_encode()
        index = langs.indices.to_numpy()
        names = np.array([_lang_key(x) for x in langs.dictionary.to_pylist()], dtype=np.uint64)
        if b.num_rows == 1 and len(texts[0].as_buffer() or b"") > 2 * BLOCK_BYTES:
            for block, limit in blocks(texts[0].as_buffer().to_pybytes(), words):
                g = Grams(pa.array([block], pa.binary()), np.array([limit]), names[index])
                yield g, langs.dictionary.take(pa.array(index[g.words.rows()]))
        elif b.num_rows:
            g = Grams(texts, np.full(b.num_rows, 1 << 60), names[index])
            yield g, langs.dictionary.take(pa.array(index[g.words.rows()]))


def _lang_key(lang: str) -> int:
    return int(Texts(pa.array([lang + "."]), np.ones(256, dtype=bool)).hashes()[0])


def _maybe(g: Grams, k: int, known: tuple[bytes, int]) -> np.ndarray:
    """Which k words in a row the filter takes for frequent."""
    keys, whole = g.keys(k)
    bits = np.frombuffer(known[0], dtype=np.uint8)
    for p in _places(keys, known[1]):
        whole = whole & ((bits[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1)
    return whole


def _all_parts(g: Grams, n: int, k: int, known: tuple[bytes, int]) -> np.ndarray:
    """Which n-grams have parts of k words that are all taken for frequent."""
    maybe = _maybe(g, k, known)
    out = maybe.copy()
    for i in range(1, n - k + 1):
        out[: len(out) - i] &= maybe[i:]
    return out


def keyed(texts: DataFrame, lengths: range, least: int, words: int, known: tuple[bytes, int] | None) -> DataFrame:
    """n, key of the n-grams of these lengths whose key comes `least` times; of those whose parts of one word less than the
    first length the filter knows.

    texts: lang (not null), text."""
    # a large value goes to the executors once, by a broadcast of at most 2^MOST_BITS bits
    sent = texts.sparkSession.sparkContext.broadcast(known) if known else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {n: [] for n in lengths}

        def combined(n: int) -> pa.RecordBatch:
            x = pc.value_counts(pa.array(np.concatenate(held[n]).view(np.int64)))
            held[n] = []
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(x), n, dtype=np.int8)), x.field("values"), x.field("counts")], ["n", "key", "f"])

        for b in batches:
            for g, _ in _parts_of(b, words):
                for n in lengths:
                    keys, which = g.keys(n)
                    which &= g.starts_here
                    if sent:
                        which &= _all_parts(g, n, lengths[0] - 1, sent.value)
                    held[n].append(keys[which])
                    if sum(map(len, held[n])) >= KEYS_HELD:
                        yield combined(n)
        for n in lengths:
            if sum(map(len, held[n])):
                yield combined(n)

    rows = texts.mapInArrow(run, "n byte, key long, f long")
    return rows.groupBy("n", "key").agg(F.sum("f").alias("f")).where(F.col("f") >= least).select("n", "key")


def bloom(keys: DataFrame) -> tuple[bytes, int]:
    """The filter of a column of keys, and log2 of its bits: BITS_EACH a key, 2^MOST_BITS at most."""
    log_bits = int(np.clip(np.ceil(np.log2(keys.count() * BITS_EACH + 1)), 16, MOST_BITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = np.concatenate(_places(b.column("key").to_numpy().view(np.uint64), log_bits))
            word, order = np.unique(p >> np.uint64(6), return_inverse=True)
            set_bits = np.zeros(len(word), dtype=np.uint64)
            np.bitwise_or.at(set_bits, order, np.uint64(1) << (p & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(set_bits.view(np.int64))], ["word", "bits"])

    # at most 2^(MOST_BITS - 6) rows of two numbers
    got = keys.select("key").mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (log_bits - 6), dtype=np.int64)
    out[got["word"].to_numpy()] = got["bits"].to_numpy()
    return out.tobytes(), log_bits


def frequent(texts: DataFrame, least: int, most_words: int) -> DataFrame:
    """lang, phrase, words, f of all phrases of up to most_words words that occur `least` times, written out."""
    filters: dict[int, tuple[bytes, int]] = {}
    for lengths in [range(n, n + 1) for n in range(1, min(most_words, ALONE) + 1)] + [range(ALONE + 1, most_words + 1)]:
        if len(lengths):
            x = checkpointed(keyed(texts, lengths, least, most_words, filters.get(lengths[0] - 1)))
            filters |= {n: bloom(x.where(F.col("n") == n)) for n in lengths}
    sent = texts.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for g, langs in _parts_of(b, most_words):
                shorter = None
                for n, known in sent.value.items():
                    maybe = _maybe(g, n, known)
                    if shorter is not None:
                        maybe[:-1] &= shorter[:-1] & shorter[1:]
                    shorter = maybe
                    at = np.flatnonzero(maybe & g.starts_here)
                    if len(at):
                        x = pa.table({"lang": langs.take(pa.array(at)), "phrase": g.phrases(n, at)})
                        x = x.group_by(["lang", "phrase"], use_threads=False).aggregate([([], "count_all")])
                        words = pa.array(np.full(len(x), n, dtype=np.int32))
                        yield from pa.table({"lang": x["lang"], "phrase": x["phrase"].cast(pa.string()), "words": words, "f": x["count_all"]}).combine_chunks().to_batches()

    rows = texts.mapInArrow(run, "lang string, phrase string, words int, f long")
    return checkpointed(rows.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f")).where(F.col("f") >= least))


def _first(k: Column) -> Column:
    """The first k words of `phrase`, the last -k for a k below 0."""
    return F.call_function("substring_index", F.col("phrase"), F.lit(" "), k)


def scored(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, phrase, words, a, l, r, n, score of the phrases of two words and more: the lowest score of their cuts, of equal ones
    that after fewest words. counts: lang, phrase, words, f; totals: lang, n."""
    whole = counts.where("words > 1")
    cut = F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")
    cuts = whole.select("lang", "phrase", "words", F.col("f").alias("a"), cut).select("*", _first(F.col("k")).alias("first"), _first(F.col("k") - F.col("words")).alias("rest"))
    part = lambda name, f: counts.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    x = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"]).join(totals, "lang")
    exact = lambda c: F.col(c).cast("decimal(18,0)")
    # div on decimals of up to 38 digits is exact; a, l and r have 15 digits at most, n 19
    x = x.withColumns({"over": (exact("a") * 1000).cast("decimal(18,0)") * F.col("n").cast("decimal(19,0)"), "under": exact("l") * exact("r")})
    best = x.groupBy("lang", "phrase", "words", "a", "n").agg(F.min(F.struct(F.expr("over div under").alias("score"), "k", "l", "r")).alias("cut"))
    return best.select("lang", "phrase", "words", "a", "cut.l", "cut.r", "n", "cut.score")


def unexplained(candidates: DataFrame) -> DataFrame:
    """Candidates without those that a candidate of one word more has inside itself as often.

    A longer one with two words more or beyond has one between them that is as often, so one word is enough."""
    parts = F.explode(F.array(_first(F.col("words") - 1), _first(1 - F.col("words")))).alias("phrase")
    longer = candidates.where("words > 2").select("lang", F.col("a").alias("longer_a"), parts).groupBy("lang", "phrase").agg(F.max("longer_a").alias("longer_a"))
    return candidates.join(longer, ["lang", "phrase"], "left").where(F.coalesce(F.col("longer_a") < F.col("a"), F.lit(True))).drop("longer_a")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 100, most_words: int = 5, top: int = 2000) -> DataFrame:
    """lang, rank (from 1), phrase, a, l, r, n, score: each language's `top` phrases of 2 to most_words words."""
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    words = F.regexp_count("text", F.lit("[^ \\t.,;:!?\\n-\\r]+")).cast("long")
    totals = texts.groupBy("lang").agg(F.coalesce(F.sum(words), F.lit(0).cast("long")).alias("n"))
    found = checkpointed(scored(frequent(texts, least, most_words), totals))
    # a language's first phrases are among the first of its groups: what one task ranks is bounded
    group, x = (F.crc32("phrase") % GROUPS).alias("group"), unexplained(found)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    for keys in (["lang", group], ["lang"]):
        x = x.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= top)
    return x.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE_SQL = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, k, w[i : i + k - 1] AS p
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM worded, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE len(w) >= k)),
counts AS (SELECT lang, k, array_to_string(p, ' ') AS phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM worded GROUP BY lang),
candidates AS (SELECT *, string_split(phrase, ' ') AS p FROM counts WHERE k > 1),
cuts AS (
  SELECT c.lang, c.phrase, c.k, c.f AS a, cut, array_to_string(p[:cut], ' ') AS first, array_to_string(p[cut + 1:], ' ') AS rest
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM candidates) c),
scored AS (
  SELECT c.lang, c.phrase, c.k, c.a, c.cut, x.f AS l, y.f AS r, t.n, ((1000::HUGEINT * c.a * t.n) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = c.first JOIN counts y ON y.lang = c.lang AND y.phrase = c.rest JOIN totals t ON t.lang = c.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inner_parts AS (
  SELECT lang, array_to_string(p[i : j], ' ') AS phrase, max(f) AS longer
  FROM (SELECT *, unnest(range(i + 1, k + 1)) AS j FROM (SELECT *, unnest(range(1, k)) AS i FROM candidates)) WHERE j - i + 1 < k GROUP BY ALL),
left_over AS (SELECT b.* FROM best b LEFT JOIN inner_parts i USING (lang, phrase) WHERE coalesce(100 * i.longer < 100 * b.a, TRUE)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM left_over)
SELECT lang, rank::INTEGER AS rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""
