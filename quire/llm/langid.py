"""Language identification with a string kernel.

The kernel of two texts is the blended spectrum of presence: the number of character n-grams (n = 1 to 4, over folded
letters) that both texts hold, n-grams taken as buckets of a fixed hash, divided by the norms. A set of landmark texts
gives the Nystroem feature map K(x, landmarks) K(landmarks, landmarks)^-1/2, and one ridge regression for each language
against the rest is solved in it. Fitting works on a bounded sample of whole texts, those with the smallest hash in
each language (`training_rows`), and is small linear algebra on the driver; scoring is two matrix products for each Arrow batch.

Letters are taken as str.isalpha() has them, lower-cased; everything else is one space. Texts that are null or have no
letter give `und` and score 0. The score says how a classifier's value stands to the others, not that it is high: of the
values of L languages the largest is 2/L - 1 at least, whatever the text. So a filter asks something else (`accepted`):
what share of the text's 4-letter sequences, repeats counted, two training texts of a language usually hold, against half of what
the median training text of that language has in common with the others. Both are shares, so neither the length of a
text nor the number of languages matters. Repeated rows are each answered; rows without a language do not train; with no
training rows at all every text is `und`; an empty table gives an empty result; a text of any length is taken whole, in
one task. Other columns are left aside in `identify` unless they are kept, and kept in `accepted`.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .durable import checkpointed
from .words import mix, slices

#: Hash buckets of the n-grams, and lengths of the n-grams.
BUCKETS = 1 << 13
LENGTHS = (1, 2, 3, 4)
#: The sample that is learned from: so many texts at most, taken whole, in turn from all languages; a language's texts are taken
#: until they have its share of so many characters, two texts at least.
TRAIN_ROWS, TRAIN_CHARS = 3000, 4_000_000
LANDMARKS = 300
#: A text is a language's own if its share of known sequences is at least so much of the median training text's.
ACCEPTED = 0.5
#: A training text holds a sequence that is one in so many of its sequences, or more.
EVERY = 5000


_rough = re.compile(r"[\W\d_]+")


@lru_cache(maxsize=1)
def _odd() -> re.Pattern:
    """What \\w takes besides digits and str.isalpha() does not: numbers such as a half or a roman twelve."""
    odd = [c for c in range(0x110000) if chr(c).isalnum() and not chr(c).isalpha() and not chr(c).isdecimal()]
    runs = [list(g) for _, g in itertools.groupby(odd, key=lambda c, n=itertools.count(): c - next(n))]
    return re.compile("[" + "".join(f"{chr(r[0])}-{chr(r[-1])}" for r in runs) + "]")


def folded(text: str | None) -> str:
    """The text's letters (by str.isalpha()) in lower case; everything else is one space, and none stands at the ends."""
    letters = _rough.sub(" ", (text or "").lower())
    if not letters.isascii() and _odd().search(letters):
        letters = re.sub(" +", " ", _odd().sub(" ", letters))
    return letters.strip()


def presence(texts: list[str | None], buckets: int = BUCKETS) -> np.ndarray:
    """One row of 0 or 1 for each text: which buckets its n-grams fall into; all 0 without letters."""
    out = np.zeros((len(texts), buckets), dtype=np.float32)
    for r, text in enumerate(texts):
        letters = folded(text)
        if not letters:
            continue
        codes = np.frombuffer(f" {letters} ".encode("utf-32-le"), dtype="<u4").astype(np.uint64)
        for n in LENGTHS:
            h = np.full(max(len(codes) - n + 1, 0), n, dtype=np.uint64)
            for i in range(n):
                h = h * np.uint64(0x100000001B3) + codes[i : i + len(h)]
            out[r, (mix(h) >> np.uint64(51)).astype(np.int64) % buckets] = 1
    return out


def sequences(text: str | None) -> np.ndarray:
    """A 32-bit hash of each run of 4 folded letters, repeats counted; one at least for a text with a letter."""
    letters = folded(text)
    if not letters:
        return np.zeros(0, dtype=np.uint32)
    codes = np.frombuffer(f" {letters}  ".encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    h = np.zeros(len(codes) - 3, dtype=np.uint64)
    for i in range(4):
        h = h * np.uint64(0x100000001B3) + codes[i : i + len(h)]
    return (mix(h) >> np.uint64(32)).astype(np.uint32)


def _share(own: np.ndarray, held: np.ndarray) -> float:
    """How much of `own` is in the sorted `held`."""
    if not len(own) or not len(held):
        return 0.0
    return float(np.mean(held[np.minimum(np.searchsorted(held, own), len(held) - 1)] == own))


def _known(texts: list[str]) -> tuple[np.ndarray, float]:
    """Sequences that two of a language's texts hold, sorted, and the share that accepts a text.

    A text holds those that it has once in EVERY at least, so that a long one, which has most sequences somewhere, vouches for
    no more than its usual ones. A sequence of two texts is known without either, so no training text vouches for itself. Of a language with a
    single text nothing is known, and all its texts are accepted."""
    each = [sequences(t) for t in texts]
    own = [v[n * EVERY >= len(s)] for s in each for v, n in [np.unique(s, return_counts=True)]]
    found, count = np.unique(np.concatenate(own), return_counts=True)
    held = found[count > 1]
    return held, ACCEPTED * float(np.median([_share(s, held) for s in each]))


def _kernel(x: np.ndarray, norms: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    return (x @ landmarks.T) / np.maximum(norms, 1e-9)[:, None]


@dataclass
class Model:
    languages: list[str]
    landmarks: np.ndarray
    weights: np.ndarray
    #: Of each language: sequences that its training texts hold, and the share of them that accepts a text.
    held: list[np.ndarray] = field(default_factory=list)
    floors: list[float] = field(default_factory=list)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        x = presence(texts)
        norms = np.sqrt(x.sum(axis=1))
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        values = np.hstack([_kernel(x, norms, self.landmarks), np.ones((len(texts), 1))]) @ self.weights
        best = values.argmax(axis=1)
        none = norms == 0
        score = np.where(none, 0.0, np.clip((values.max(axis=1) + 1) / 2, 0, 1))
        return ["und" if z else self.languages[b] for b, z in zip(best, none, strict=True)], score

    def accepts(self, texts: list[str | None]) -> np.ndarray:
        """Whether any language takes the text for its own; the predicted one is mostly right, so it is asked first.

        If nothing could be learned, no language refuses a text, and all with a letter are accepted."""
        if not self.languages:
            return np.array([bool(folded(t)) for t in texts], dtype=bool)
        out = np.zeros(len(texts), dtype=bool)
        for r, (text, lang) in enumerate(zip(texts, self.predict(texts)[0], strict=True)):
            if lang != "und":
                own, first = sequences(text), self.languages.index(lang)
                out[r] = any(_share(own, self.held[k]) >= self.floors[k] for k in [first, *range(len(self.languages))])
        return out


def fit(texts: list[str], languages: list[str], landmarks: int = LANDMARKS, ridge: float = 1e-2) -> Model:
    """texts without letters are left out."""
    kept = [(t, v) for t, v in zip(texts, languages, strict=True) if folded(t)]
    texts, y = [t for t, _ in kept], [v for _, v in kept]
    known = sorted(set(y))
    if not known:
        return Model([], np.zeros((0, BUCKETS), np.float32), np.zeros((1, 0)))
    chosen: list[int] = []
    by = {v: [i for i, w in enumerate(y) if w == v] for v in known}
    while len(chosen) < min(landmarks, len(y)):  # in turn from each language, so that a rare one has landmarks too
        chosen += [rows.pop(0) for rows in by.values() if rows]
    base = presence([texts[i] for i in chosen[:landmarks]])
    base /= np.sqrt(base.sum(axis=1))[:, None]
    values, vectors = np.linalg.eigh((base @ base.T).astype(np.float64))
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    products = []
    for i in range(0, len(texts), 256):  # a few at a time: n-grams are many, landmarks few
        x = presence(texts[i : i + 256])
        products.append(_kernel(x, np.sqrt(x.sum(axis=1)), base))
    features = np.hstack([np.concatenate(products).astype(np.float64) @ root, np.ones((len(texts), 1))])
    targets = np.where(np.array(y)[:, None] == np.array(known)[None, :], 1.0, -1.0)
    penalty = ridge * len(texts) / 100 * np.eye(features.shape[1])
    penalty[-1, -1] = 0
    solved = np.linalg.solve(features.T @ features + penalty, features.T @ targets)
    held, floors = zip(*(_known([t for t, w in zip(texts, y, strict=True) if w == v]) for v in known), strict=True)
    return Model(known, base, np.vstack([root @ solved[:-1], solved[-1:]]), list(held), list(floors))


def training_rows(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> DataFrame:
    """The bounded sample that is learned from: text and lang of different texts, in order of a hash of each, the first of every
    language, then the second, and so on, up to `rows`. A text of any length may be among them; a language stops when its
    texts have its share of `chars`, but not before the second. Hashes are ranked first, so texts are fetched for those alone."""
    x = docs.select(F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL").withColumn("h", F.xxhash64("text"))
    each = x.groupBy("lang", "h").agg(F.max(F.length("text")).alias("size"))
    # a language's first texts are among the first of its groups, so what one task ranks is bounded
    first = each
    for keys in (["lang", F.pmod("h", F.lit(64))], ["lang"]):
        first = first.withColumn("turn", F.row_number().over(Window.partitionBy(*keys).orderBy("h"))).where(F.col("turn") <= rows)
    # languages with a text among the first `rows`: no more than that many
    first = checkpointed(first.orderBy("turn", "h", "lang").limit(rows))
    share = chars / max(1, first.select("lang").distinct().count())
    upto = F.sum("size").over(Window.partitionBy("lang").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1))
    kept = first.withColumn("upto", F.coalesce(upto, F.lit(0))).where((F.col("upto") < share) | (F.col("turn") <= 2)).select("lang", "h")
    return x.join(F.broadcast(kept), ["lang", "h"]).groupBy("lang", "h").agg(F.first("text").alias("text")).orderBy("h", "lang").select("text", "lang")  # at most `rows` are broadcast


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", rows: int = TRAIN_ROWS) -> Model:
    sample = training_rows(docs, text_col, lang_col, rows).collect()
    return fit([r.text for r in sample], [r.lang for r in sample])


def identify(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (all, if None) and lang_pred, score; columns of these two names are replaced. No shuffle.

    The model goes to the executors once; its size is set by LANDMARKS, BUCKETS and the bounded training texts alone."""
    spark = docs.sparkSession
    x = docs.select(*[F.col(f"`{c}`") for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score")], F.col(f"`{text_col}`").alias("__text"))
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for part in (s for b in batches for s in slices(b, "__text", 1 << 20)):
            for i in range(0, part.num_rows, 256):
                b = part.slice(i, 256)
                lang, score = m.predict(b.column("__text").to_pylist())
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*b.schema.names[:-1], "lang_pred", "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in x.schema.fields[:-1])
    return x.mapInArrow(run, f"{fields}{', ' if fields else ''}lang_pred string, score double")


def accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs whose text some language takes for its own, all columns kept. No shuffle."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for part in (s for b in batches for s in slices(b, b.schema.names[at], 1 << 20)):
            for i in range(0, part.num_rows, 256):
                b = part.slice(i, 256)
                yield b.filter(pa.array(m.accepts(b.column(at).to_pylist()), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
