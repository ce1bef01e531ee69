"""Quality rules: text statistics and a decision list that is learned from them.

The statistics of each whole text come from one pass without a shuffle. The list is learned by sequential covering:
each rule is a conjunction of thresholds that is grown on two thirds of the labelled rows by information gain, pruned
on the other third, and kept if it is precise enough there; rows that it covers are taken out before the next one.
Rules name texts of low quality, in order; a text that none covers is kept. The list becomes one Spark conditional
expression over the statistics.

Words: runs of `[^\\x20\\x09-\\x0D]`. Null and empty texts have 0 in every statistic. Repeated rows are each answered.
Labels that are null, or of no document, do not train; without labels of both kinds the list is empty. An empty table
gives an empty result; a text of any length is taken whole, in one task. Other columns are left aside.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import NOT_SPACE, Texts, byte_table, mix, slices

#: Characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words", "n_digits", "n_punctuation", "n_long_words"]
#: Labelled rows that are learned from, at most: those with the smallest hash of their id.
TRAIN_ROWS = 10_000


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _keys(rows: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(hashes + rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _first_seen(keys: np.ndarray) -> np.ndarray:
    """False where a key has come before."""
    first = np.zeros(len(keys), dtype=bool)
    first[np.unique(keys, return_index=True)[1]] = True
    return first


def measure(column: pa.Array) -> list[np.ndarray]:
    """The STATISTICS of each text."""
    t = Texts(column)
    data, o = t.data, t.offsets
    table = lambda chars: np.isin(np.arange(256), list(chars))
    h, rows = t.hashes(), t.rows()
    n = len(t.counts)
    lines = Texts(column, byte_table(b"\n"))
    worded = np.add.reduceat(NOT_SPACE[data], lines.starts) > 0 if len(lines.starts) else np.zeros(0, bool)
    line_rows = lines.rows()
    repeated_lines = worded & ~_first_seen(_keys(line_rows, lines.hashes()) ^ worded.astype(np.uint64))
    grams, whole = t.grams(h, 3)
    at = np.flatnonzero(whole)
    _, of, count = np.unique(_keys(rows[at], grams[at]), return_inverse=True, return_counts=True)
    at = at[count[of] > 1]
    covered = np.zeros(len(h), dtype=bool)
    for i in range(3):
        covered[at + i] = True
    sizes = t.ends - t.starts
    return [
        t.counts,
        _sums(NOT_SPACE[data] & ((data & 0xC0) != 0x80), o),
        _sums(table(SYMBOLS)[data], o),
        np.bincount(line_rows[repeated_lines], minlength=n),
        np.bincount(rows[covered], minlength=n),
        np.bincount(line_rows[worded], minlength=n),
        np.bincount(rows[_first_seen(_keys(rows, h))], minlength=n),
        _sums(table(b"0123456789")[data], o),
        _sums(table(b".,;:!?'\"()-")[data], o),
        np.bincount(rows[sizes > 20], minlength=n),
    ]


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the STATISTICS, all long."""
    x = docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (s for x in batches for s in slices(x, "text")):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(v, pa.int64()) for v in measure(b.column("text")))], ["doc_id", *STATISTICS])

    return x.mapInArrow(run, f"doc_id {x.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in STATISTICS))


#: What rules compare: a count, or one count as a share of another.
FEATURES = {
    "n_words": ("n_words", None),
    "chars per word": ("word_chars", "n_words"),
    "symbols per char": ("n_symbols", "word_chars"),
    "repeated lines": ("n_dup_lines", "n_lines"),
    "repeated words": ("n_repeat_words", "n_words"),
    "distinct words": ("n_distinct_words", "n_words"),
    "digits per char": ("n_digits", "word_chars"),
    "punctuation per char": ("n_punctuation", "word_chars"),
    "words per line": ("n_words", "n_lines"),
    "long words": ("n_long_words", "n_words"),
}


def feature(name: str) -> Column:
    of, by = FEATURES[name]
    return F.col(of).cast("double") if by is None else F.col(of) / F.greatest(F.col(by), F.lit(1))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        x = feature(self.feature)
        return x >= F.lit(self.threshold) if self.above else x < F.lit(self.threshold)

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.threshold if self.above else x[self.feature] < self.threshold


def _covers(rule: list[Condition], x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, dtype=bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _best(x: dict[str, np.ndarray], bad: np.ndarray, inside: np.ndarray, steps: int) -> Condition | None:
    """The threshold with the largest gain over the rows inside."""
    p0, n0 = int((bad & inside).sum()), int((~bad & inside).sum())
    best, gain = None, 1e-9
    for name, v in x.items():
        for threshold in np.unique(np.quantile(v[inside], np.linspace(0, 1, steps))):
            for above in (True, False):
                got = inside & (v >= threshold if above else v < threshold)
                p, n = int((bad & got).sum()), int((~bad & got).sum())
                if p and n < n0:
                    g = p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))
                    if g > gain:
                        best, gain = Condition(name, above, float(threshold)), g
    return best


def learn(x: dict[str, np.ndarray], bad: np.ndarray, precision: float = 0.95, least: int = 5, most_rules: int = 12, most_conditions: int = 4, steps: int = 41) -> list[list[Condition]]:
    """Ordered rules that name bad rows; every third row prunes, the others grow."""
    rules: list[list[Condition]] = []
    n = len(bad)
    prune = np.arange(n) % 3 == 2
    left = np.ones(n, dtype=bool)
    while len(rules) < most_rules and (bad & left & ~prune).sum() >= least:
        rule, inside = [], left & ~prune
        while len(rule) < most_conditions and (~bad & inside).any():
            c = _best(x, bad, inside, steps)
            if c is None:
                break
            rule.append(c)
            inside &= c.holds(x)

        def value(r: list[Condition]) -> tuple[float, int]:
            got = _covers(r, x, n) & left & prune
            p, q = int((bad & got).sum()), int((~bad & got).sum())
            return ((p - q) / (p + q) if p + q else -1.0, p)

        rule = max((rule[: k + 1] for k in range(len(rule))), key=value, default=[])
        got = _covers(rule, x, n) & left
        if not rule or (bad & got & prune).sum() < 2 or (bad & got & prune).sum() < precision * (got & prune).sum() or (bad & got).sum() < precision * got.sum():
            break
        rules.append(rule)
        left &= ~got
    return rules


def verdict(rules: list[list[Condition]]) -> Column:
    """True for texts that no rule names; rules are asked in order."""
    out: Column | None = None
    for rule in rules:
        c = rule[0].column()
        for other in rule[1:]:
            c = c & other.column()
        out = F.when(c, F.lit(False)) if out is None else out.when(c, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def learn_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAIN_ROWS, **options) -> list[list[Condition]]:
    """Rules from at most `rows` labelled rows; only those are measured for it."""
    chosen = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).where("id IS NOT NULL AND label IS NOT NULL").orderBy(F.xxhash64("id"), "id", "label").limit(rows)
    x = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen.select("id").distinct()), F.col("doc_id") == F.col("id"), "left_semi")
    # one row for each label and text; at most `rows` labels, and equal ids are rare
    got = statistics(x).join(F.broadcast(chosen), F.col("doc_id") == F.col("id")).select("label", *[feature(f).alias(f"f{i}") for i, f in enumerate(FEATURES)], F.xxhash64("doc_id").alias("h")).orderBy("h", "label").limit(rows).toPandas()
    return learn({f: got[f"f{i}"].to_numpy(dtype=float) for i, f in enumerate(FEATURES)}, got["label"].to_numpy() == 0, **options)


def judge(docs: DataFrame, rules: list[list[Condition]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the STATISTICS, base_failed and kept."""
    x = statistics(docs, id_col, text_col)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return x.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict(rules))
