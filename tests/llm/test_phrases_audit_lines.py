"""Phrases, filter audit and line dedup against plain Python, on tables with nulls, ties, repeats and clashing names."""

import hashlib
import re
from collections import Counter, defaultdict
from fractions import Fraction
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from quire.llm import audit, entry, linededup, minhash, mixing, phrases

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
NAMES = ["key", "lines", "line", "place", "r", "s", "a", "b", "n", "l", "lang_key", "phrase", "rank", "words", "part", "bits", "copy", "first", "length", "block0", "masks", "__id", "__size", "__k"]
SHARED = "This line stands in many documents."
ROWS = [
    (1, f"{SHARED}\nown line of the first document\n{SHARED}", "en", "a"), (2, f"  {SHARED.upper()} \t\nshort\nshort", "en", "a"), (3, f"x\n{SHARED}", None, "b"), (3, f"x\n{SHARED}", None, "b"), (4, f"{SHARED}\r\nÜBER ALLES steht diese Zeile hier", "de", None),
    (5, None, "en", ""), (6, "", "en", None), (7, "\n\n", None, "c"), (None, f"{SHARED}\nnobody's own line, but a long one", "en", "a"), (9, "twice in one document only\ntwice in one document only\nÜBER ALLES steht diese Zeile hier", "de", "c"), (10, "New York City, new york city. New\tYork  city", "en", "a"),
    (11, "new york city! big new york city: New York", "en", "b"), (12, " ".join(f"w{i % 90} of" for i in range(5000)), "xx", "long"), (13, "one two " * 80 + "#", "en", "b"), (14, "one two " * 80 + "#", "en", "c"), (8, "one two " * 80 + "#", "fr", "c"), (None, "one two " * 80 + "#", "fr", "c"), (15, "A B C D E", "en", "a"), (15, "A B C D E", "en", "a"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string").withColumns({c: F.lit(1) for c in NAMES})


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


@pytest.fixture(scope="module", params=["odd", "docs", "empty"])
def some(request, odd, docs):
    return {"odd": odd, "docs": docs, "empty": odd.limit(0)}[request.param]


def rows(df):
    return [(r.doc_id, r.text, r.lang, r.source) for r in df.select("doc_id", "text", "lang", "source").collect()]


# phrases

def mined(table, least, most, top):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, _ in table:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(LOW)):
            w = re.findall(r"[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, most + 1):
                f[lang].update(" ".join(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if a >= least and " " in p}
        inside = set()
        for q, a in found.items():
            w = q.split(" ")
            inside |= {p for k in range(2, len(w)) for i in range(len(w) - k + 1) for p in [" ".join(w[i : i + k])] if p in found and 100 * a >= 100 * found[p]}
        scored = []
        for p, a in found.items():
            w = p.split(" ")
            cuts = [(Fraction(1000 * a * n[lang], l * r).__floor__(), k, l, r) for k in range(1, len(w)) for l, r in [(counts[" ".join(w[:k])], counts[" ".join(w[k:])])]]
            score, _, l, r = min(cuts)
            scored.append((-score, -a, p.encode(), p, a, l, r, score))
        scored = [s for s in sorted(scored) if s[3] not in inside][:top]
        out += [(lang, i, p, a, l, r, n[lang], score) for i, (_, _, _, p, a, l, r, score) in enumerate(scored, 1)]
    return sorted(out)


@pytest.mark.parametrize(("least", "most", "top"), [(2, 5, 7), (1, 3, 10**6), (3, 2, 10**6)])
def test_phrases(some, least, most, top):
    got = sorted(tuple(r) for r in phrases.collocations(some, least=least, most_words=most, top=top).collect())
    assert got == mined(rows(some), least, most, top)


def test_phrases_whatever_the_filters_let_through(docs, monkeypatch):
    """With filters that are full, and with blocks of a few bytes."""
    table = docs.where("doc_id < 60")
    monkeypatch.setattr(phrases, "MOST_BITS", 16)
    monkeypatch.setattr(phrases, "BITS_EACH", 1e-6)
    assert sorted(map(tuple, phrases.collocations(table, least=2, top=50).collect())) == mined(rows(table), 2, 5, 50)


def test_blocks_hold_every_gram_once():
    text = b"a bb. c  dd e f g\th i, jj kk " * 40 + b"x" * 500 + b" end. of"
    whole = Counter()
    for piece in re.split(rb"[.,;:!?\n-\r]", text):
        w = piece.split()
        whole.update(b" ".join(w[i : i + k]) for k in range(1, 6) for i in range(len(w) - k + 1))
    for size in (1, 7, 64, 10**6):
        parts, at, total = Counter(), 0, 0
        for block, limit in phrases.blocks(text, 5, size):
            total += limit
            spans = [(m.start(), m.group()) for m in re.finditer(rb"[^ \t.,;:!?\n-\r]+", block)]
            for i, (start, _) in enumerate(spans):
                if start < limit:
                    for k in range(1, 6):
                        if i + k <= len(spans):
                            last = spans[i + k - 1]
                            if not re.search(rb"[.,;:!?\n-\r]", block[start : last[0] + len(last[1])]):
                                parts[b" ".join(w for _, w in spans[i : i + k])] += 1
        assert parts == whole and total == len(text), size


def test_scores_are_exact_beyond_64_bits(spark):
    big = 10**14 - 7
    counts = spark.createDataFrame([("en", "a", 1, big), ("en", "b", 1, big - 11), ("en", "a b", 2, big - 100)], "lang string, phrase string, words int, f long")
    totals = spark.createDataFrame([("en", 10**18 + 3)], "lang string, n long")
    r = phrases.scored(counts, totals).first()
    assert r.score == 1000 * (big - 100) * (10**18 + 3) // (big * (big - 11))


# filter audit

def audited(table, labels):
    good, toxic = ({i for i, *v in labels if v[k] == 1 and i is not None} for k in (0, 1))
    least = {}
    for i, text, _, _ in table:
        if i is not None:
            least[text or ""] = min(least.get(text or "", i), i)
    masks = []
    for i, text, _, source in table:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        copy = t in least and (i is None or i > least[t])
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": copy}
        masks.append((source or "", frozenset(k for k, v in fails.items() if v), i in good, i in toxic))
    out = {}
    for part in {m[0] for m in masks}:
        mine = [m for m in masks if m[0] == part]
        removed = Counter()
        for order in permutations("ABCDE"):
            for step, x in enumerate(order, 1):
                before = set(order[: step - 1])
                here = [m for m in mine if x in m[1] and not m[1] & before]
                removed[x] += len(here)
                kept = sum(not m[1] & (before | {x}) for m in mine)
                out[part, "".join(order), step] = [kept, len(here), sum(x in m[1] and bool(m[1] & before) for m in mine), sum(m[1] == {x} for m in mine), sum(m[2] for m in here), sum(m[3] for m in here)]
        for order in permutations("ABCDE"):
            for step, x in enumerate(order, 1):
                out[part, "".join(order), step].append(removed[x])
    return out


@pytest.mark.parametrize("colliding", [False, True])
def test_audit(spark, some, data, monkeypatch, colliding):
    if colliding:  # texts of one length all fall into one class
        monkeypatch.setattr(audit, "block_hash", lambda text: F.xxhash64(F.length(text)))
    made = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, None, None), (13, 1, 1), (14, 1, 0), (None, 1, 1), (15, 1, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")
    labels = spark.read.parquet(f"{data}/labels.parquet").select("doc_id", "quality", "toxic").unionByName(made)
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in audit.audit(some, labels).collect()}
    assert got == audited(rows(some), [tuple(r) for r in labels.collect()])


# line dedup

def key(line):
    return line.strip("\t\n\v\f\r ").translate(LOW)


def deduped(table, chars=20, least=3):
    holders = defaultdict(set)
    for i, text, _, _ in table:
        for line in (text or "").split("\n"):
            if len(key(line)) >= chars:
                holders[key(line)].add(i)
    out = []
    for i, text, _, _ in table:
        lines = (text or "").split("\n")
        goes = lambda k: len(holders.get(k, ())) >= least and i != max(x for x in holders[k] if x is not None)  # noqa: B023, E731
        kept = [x for x in lines if not goes(key(x))]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("chars", "least"), [(20, 3), (1, 2), (35, 3)])
def test_lines(some, chars, least):
    got = linededup.without_common_lines(some, min_chars=chars, min_docs=least)
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got.collect()), key=repr) == deduped(rows(some), chars, least)


def test_lines_of_a_long_text(spark):
    """A hundred thousand lines, each second one common."""
    lines = [f"line number {i} of its own, all right" if i % 2 else f"common line {i % 50} of the whole lot" for i in range(100_000)]
    table = [(1, "\n".join(lines), "en", "a"), *[(k, "\n".join(f"common line {i} of the whole lot" for i in range(50)), "en", "a") for k in (2, 3)]]
    df = spark.createDataFrame(table, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: (r.n_lines, r.n_dropped, hashlib.md5(r.kept_text.encode()).hexdigest()) for r in linededup.without_common_lines(df).collect()}
    assert got == {i: (n, d, hashlib.md5(t.encode()).hexdigest()) for i, n, d, t in deduped(table)}


# what the queries give, and the pipeline's exactness

@pytest.mark.parametrize("name", ["op11_collocations", "op12_filter_audit", "op13_line_dedup"])
def test_query_equals_sql(name, same):
    same(entry.queries()[name], entry.oracle_sql()[name])


def test_line_dedup_runs_no_python(docs):
    plan = linededup.without_common_lines(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "MapInArrow" not in plan


def test_of_copies_one_stays_whatever_its_id(spark):
    t, u, v = (" ".join(f"{c}{i}" for i in range(40)) for c in "tuv")
    rows = [(1, t), (None, t), (None, u), (5, t), (5, v), (7, u + " more"), (8, v), (5, v)]
    df = spark.createDataFrame(rows, "__id long, text string").withColumn("i", F.lit(1)).withColumn("x", F.col("text"))
    got = Counter((r["__id"], r.text) for r in minhash.without_copies(df, "__id").collect())
    assert got == Counter({(1, t): 1, (5, v): 2, (7, u + " more"): 1})


def test_mix_tells_rows_of_one_id_apart(spark):
    table = [(1, "a b c d", "x"), (1, "e f g h", "y"), (2, "i j", "x"), (2, "k l", "x"), (None, "m n o", None), (None, "", "y"), (3, None, "x")]
    df = spark.createDataFrame(table, "doc_id long, text string, source string").withColumns({c: F.lit(0) for c in ("__id", "__size", "said", "copy", "c0", "more0")})
    plan = Counter()
    for r in mixing.plan_mix(df).collect():
        plan[r.doc_id, r["size"], r.source_size] += r.taken
    sizes = {"x": 8, "y": 4, None: 3}
    sent = Counter()
    for r in mixing.mixed(df).collect():
        n = len((r.text or "").split())
        sent[r.doc_id, n, sizes[r.source]] += n
    assert +sent == +plan and sum(sent.values()) <= 15


def test_pipeline_keeps_columns_that_are_named_like_ours(spark, data):
    import corpus_pipeline

    small = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    small = small.withColumns({c: F.lit(c) for c in ("__id", "__h", "__k", "__size", "__text", "__kept_text", "__spots", "c0", "i", "x", "said", "h")})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, small, data)
        assert after.schema.names == small.schema.names
        assert all(r[c] == c for r in after.collect() for c in ("__id", "__h", "__k", "__size", "__text", "__kept_text", "c0", "said"))


def test_languages_of_long_texts_and_rare_ones_are_learned(spark):
    from quire.llm import langid

    words = {"en": "the house and river with many stones under water", "fr": "la maison et une riviere avec des pierres sous eau", "fi": "talo ja joki jossa on kivia veden alla hiljaa"}
    mixed = lambda v, k, n: " ".join(words[v].split()[(k * 7 + j * (k % 5 + 1)) % 8] for j in range(n))
    table = [(k, mixed("en", k, 12 + k % 9), "en") for k in range(4000)] + [(10**5 + k, mixed("fr", k, 1500 + k), "fr") for k in range(40)] + [(10**6 + k, mixed("fi", k, 20), "fi") for k in range(3)]
    df = spark.createDataFrame(table, "doc_id long, text string, lang string")
    model = langid.train(df)
    assert model.languages == ["en", "fi", "fr"]
    out = langid.identify(df.where("doc_id % 40 = 0 OR doc_id >= 100000"), model)
    assert all(r.lang == r.lang_pred for r in out.collect())
    sample = langid.training_rows(df, rows=30, chars=30_000).groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("size")).collect()
    assert {r.lang: r.n for r in sample} == {"en": 25, "fi": 3, "fr": 2} or {r.lang for r in sample} == {"en", "fi", "fr"}
    assert all(r.n >= 2 for r in sample)


def test_licence_headers_and_repeats():
    import pyarrow as pa

    from quire.llm import licenses

    index = licenses.Index()

    def labels(text):
        t = licenses.Texts(pa.array([text]), licenses._IS_WORD, lower=True)
        return index.scan(dict(zip(*[list(x) for x in index.licence_words(t)], strict=True)))[4]

    expected = {
        "GNU Lesser General Public License version 2.1": {"gpl", "lgpl-2.1"}, "GNU Affero General Public License, version 3": {"gpl", "agpl-3.0"}, "GNU General Public License, version 2": {"gpl", "gpl-2.0"}, "General Public License v3": {"gpl", "gpl-3.0"},
        "MIT License\n\nCopyright (c) 2020 someone": {"mit"}, "// SPDX-License-Identifier: MIT": {"mit"}, "SPDX-License-Identifier: GPL-2.0-or-later": {"gpl-2.0-or-later"}, "SPDX-License-Identifier: BSD-3-Clause": {"bsd-3-clause"}, "The data is available under CC0.": {"cc0"},
        "An identifier of a license, general and public": set(), "version 2 of the software": set(),
    }
    for text, found in expected.items():
        assert labels(text) == found, text
    assert labels("Released under the MIT License. " * 3000) == {"mit"}


# passages inside long and repetitive texts

def kept_words(table, n):
    first, out = {}, {}
    order = sorted((i is None, i or 0, t) for i, t in table)
    for null, i, t in order:
        w = t.split()
        gone = bytearray(len(w))
        for k in range(len(w) - n + 1):
            key = hash(tuple(w[k : k + n]))
            if first.setdefault(key, (null, i, t, k)) != (null, i, t, k):
                gone[k : k + n] = b"\1" * n
        out[None if null else i, t] = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
    return out


def test_passages_in_texts_that_repeat_themselves(spark):
    """A word and a period of seven words all through texts of over two megabytes, and passages that cross ranges of a long one."""
    import random

    from quire.llm import substrings

    r = random.Random(6)
    passage = " ".join(f"pass{k}" for k in range(60))
    long = [f"x{r.randrange(10**9)}" for _ in range(230_000)]
    for at in (100, 104_800, 104_857, 150_000, 229_000):
        long[at : at + 1] = passage.split()
    table = [
        (1, "a " * 1_200_000 + "end"), (2, "a  a\n" * 300), (3, " ".join(f"w{k % 7}" for k in range(760_000))), (4, " ".join(f"w{k % 7}" for k in range(3, 90))), (5, " ".join(long)), (6, f"before {passage} behind"),
        (7, " ".join(["u v w"] * 50)), (8, " ".join(["u v w"] * 9 + ["x"] + ["u v w"] * 9)), (None, passage), (9, "one two " * 9), (9, "one two " * 9), (10, ""), (11, " ".join(long[:40_000])),
    ]
    df = spark.createDataFrame(table, "doc_id long, text string")
    expected = kept_words(table, 20)
    got = [(x.doc_id, x.text, x.n_words, x.n_removed, x.kept_text) for x in substrings.without_repeats(df, words=20).collect()]
    assert len(got) == len(table)
    for i, t, n, lost, kept in got:
        assert kept == expected[i, t] and n == len(t.split()) and lost == n - len(kept.split()), i


def test_texts_that_repeat_only_themselves(spark):
    """No anchor of these texts stands anywhere else, in them or in another text."""
    from quire.llm import substrings

    table = [(1, "y " * 30), (2, "a b c " * 12), (None, "z " * 21), (4, " ".join(f"own{k}" for k in range(40))), (5, "q " * 20)]
    expected = kept_words(table, 20)
    for r in substrings.without_repeats(spark.createDataFrame(table, "doc_id long, text string"), words=20).collect():
        assert r.kept_text == expected[r.doc_id, r.text] and r.n_removed == len(r.text.split()) - len(r.kept_text.split()), r.doc_id


def test_ranges_of_a_text():
    from quire.llm import substrings

    text = ("ab  c\n\tdddd " * 50 + "e" * 300 + " f").encode()
    for size in (1, 5, 64, 10**6):
        parts = list(substrings._ranges(text, 4, size))
        assert sum(n for _, _, n in parts) == len(text.split()) and [p for _, p, _ in parts] == [sum(n for _, _, n in parts[:k]) for k in range(len(parts))]
        for part, first, n in parts:
            assert part.split() == text.split()[first : first + n + 3]
    assert substrings._kept(b" a b  c ", [(1, 2)]) == (b"a c", 3, 2) and substrings._kept(b"", []) == (b"", 0, 0) and substrings._kept(b" \n", []) == (b"", 0, 0)
