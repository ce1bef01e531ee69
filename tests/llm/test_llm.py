import hashlib
import re
import struct
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import ann, bpe, chat, components, entry, langid, licenses, minhash, mixing, quality, substrings, tokencount
from quire.llm.durable import checkpointed

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = " ".join(f"wörd{i % 977} tail{i}" for i in range(9000))
P20 = " ".join(f"p{i}" for i in range(30))
#: Nulls in every column, empty and blank texts, a very long one, copies, near copies, a repeated row, odd characters.
ROWS = [
    (0, "Licensed under CC BY 4.0. All rights reserved.\nAll rights reserved", "en", "a"), (1, None, "de", "a"), (2, "", None, "b"), (3, " \t\n", "en", None), (4, LONG, "fr", "b"), (5, LONG, "fr", "b"),
    (6, f"one two {P20} three", "en", "a"), (7, f"{P20} four {P20}", "en", None), (8, "<|endoftext|> ’tis  é 日本語  x", None, "c"), (9, "GNU General Public License version 3", "en", "c"), (9, "GNU General Public License version 3", "en", "c"),
    (10, "one two", "en", "a"), (11, "One  TWO", "en", "a"), (12, "1234 !!", "en", "b"), (None, "no id here", None, None),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Columns whose names the operators use themselves are there too."""
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    return df.withColumns({c: F.lit(1) for c in ("n", "h", "x", "key", "score", "kept_text", "size")})


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


@pytest.fixture(scope="module")
def tables(docs, odd):
    return {"docs": docs, "odd": odd, "empty": docs.limit(0)}


def got(df):
    return [r.asDict() for r in df.collect()]


def texts(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", ["docs", "odd", "empty"])
def test_licences(tables, name):
    df = tables[name]
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    expected = Counter()
    for i, t in texts(df):
        w = word.findall(t.translate(LOW))
        at = [(k, k, v) for s, v in licenses.BASE.items() for p in [s.split()] for k in range(len(w)) if w[k : k + len(p)] == p]
        expected[i, len(w), len(at), min((a for a, _, _ in at), default=None), max((a for a, _, _ in at), default=None), ",".join(sorted({v for _, _, v in at}))] += 1
    out = got(licenses.scan_licences(df))
    assert Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in out) == expected
    assert all(0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) for r in out)
    if name == "odd":
        assert next(r for r in out if r["doc_id"] == 9)["labels"] == "gpl,gpl-3.0"


LICENCE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def licence_labels(text, templates):
    """Brute force: every template is laid at every start that one of its rare words asks for."""
    split = lambda t: LICENCE_WORD.findall(t.translate(LOW))
    all_words = [split(t) for _, t, _ in templates]
    idf = {w: np.log((1 + len(templates)) / sum(w in t for t in all_words)) for t in all_words for w in t}
    words, found = split(text), []
    for (label, _, keys), t in zip(templates, all_words, strict=True):
        rare = sorted(set(t), key=lambda w: (-idf[w], -len(w), w))[: licenses.RARE]
        slack = len(t) // 8 if len(t) > 16 else 0
        for s in {p - q for q, w in enumerate(t) if w in rare for p, x in enumerate(words) if x == w}:
            near = lambda q, w: w in words[max(s + q, 0) : max(s + q + slack + 1, 0)]
            agree = {w for q, w in enumerate(t) if w in rare and near(q, w)}
            whole = all(any(t[q : q + len(k.split())] == k.split() and words[b + q : b + q + len(k.split())] == k.split() for q in range(len(t)) for b in range(s, s + slack + 1) if b + q >= 0) for k in keys)
            covered = sum(idf[w] for q, w in enumerate(t) if near(q, w)) / sum(idf[w] for w in t)
            if len(agree) >= np.ceil(licenses.VOTES * len(rare)) and whole and covered >= licenses.COVERAGE:
                found.append((s, s + slack + len(t), len(t), label, covered))
    best = [m for m in found if not any(o[0] <= m[0] and m[1] <= o[1] and m[2] < o[2] for o in found)]
    base = {v for k, v in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(k.split())] == k.split()}
    return {m[3] for m in best} | base, max([m[4] for m in best], default=0.5 if base else 0.0) if not base else max([0.5, *(m[4] for m in best)])


def test_licence_labels(spark):
    """Licences with words changed, taken out and put in, between other words; and what only looks like one."""
    import random

    r = random.Random(3)
    noise = [*"the of and a license software under version public granted mit apache 2 0 notice use copy".split(), *(f"w{i}" for i in range(40))]
    texts = ["we will mit license nothing here", "apache license version 2 0", "mit license", "", None, "# * Licensed under the\n# * Apache License, Version 2.0", "licensed under cc by sa and cc by nc 4 0 all rights reserved"]
    for _, t, _ in licenses.TEMPLATES * 3:
        w = [x for x in t.split() if r.random() > r.choice([0, 0.02, 0.1])]
        w = [x if r.random() > 0.02 else r.choice(noise) for x in w]
        for _ in range(r.choice([0, 0, 2, 5])):
            w.insert(r.randrange(len(w) + 1), r.choice(noise))
        texts.append(" ".join([*r.choices(noise, k=r.randrange(30)), *w, *r.choices(noise, k=r.randrange(30))]))
    out = got(licenses.scan_licences(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    labels = Counter()
    for row in out:
        expected, score = licence_labels(texts[row["doc_id"]] or "", licenses.TEMPLATES)
        assert set(filter(None, row["labels"].split(","))) == expected and abs(row["score"] - min(score, 1)) < 1e-9
        labels.update(expected)
    assert len(out) == len(texts) and len(labels) >= 20 and out[0]["labels"] == out[2]["labels"] == "" and out[1]["labels"] == "apache-2.0"


@pytest.mark.parametrize("name", ["docs", "odd", "empty"])
@pytest.mark.parametrize("leaf", [64, bpe.LEAF_CHARS])
def test_bpe(tables, name, leaf):
    df, path = tables[name], entry.tokenizer("word_bpe_49k.json")
    if name == "docs" and leaf == 64:
        df = df.where("length(text) < 3000").limit(60)
    lib = bpe.library(path)
    expected = Counter()
    for i, t in texts(df):
        ids = lib.encode(t, add_special_tokens=False).ids
        expected[i, struct.pack(f"<{len(ids)}I", *ids), lib.decode(ids, skip_special_tokens=False)] += 1
    assert Counter((r["doc_id"], bytes(r["ids"]), r["decoded"]) for r in got(bpe.encode(df, path, leaf_chars=leaf, decoded=True))) == expected


@pytest.mark.parametrize("name", ["docs", "odd", "empty"])
def test_token_counts(tables, name):
    df, path = tables[name], entry.tokenizer("byte_bpe_50k.json")
    lib = bpe.library(path)
    count = lambda t: len(lib.encode(t, add_special_tokens=False).ids)
    out = got(tokencount.token_counts(df, path, limit=40))
    assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in out) == Counter((i, len(t.encode()), count(t)) for i, t in texts(df))
    by = {i: t for i, t in texts(df)}
    for r in out[:40]:
        prefix = tokencount.prefix_counts(bytes(r["prefix_table"]))
        for n in range(1, min(len(by[r["doc_id"]]), 120), 7):
            assert prefix[n - 1] == count(by[r["doc_id"]][:n])


def test_chats(same, spark):
    same(entry.op3_chat_format, chat.ORACLE_SQL)
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "a"), (3, 0, "user", "a"), (3, 1, "assistant", "b"), (4, 0, None, None), (5, 0, "", ""), (None, 0, "user", "<|im_end|>")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("n", F.lit(1))
    out = {r["conv_id"]: r["rendered"] for r in got(chat.format_chats(df))}
    assert set(out) == {1, 4, 5, None} and out[1] == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n" and out[None].count("<|im_end|>") == 1
    assert got(chat.format_chats(df.limit(0))) == []


def test_a_long_conversation_over_many_ranges(spark):
    """One conversation with most of all turns, snapshots of it, and rows in no order: as brute force has it."""
    import random

    r = random.Random(8)
    log = [("user" if k % 2 == 0 else "assistant", f"turn {k // 3}") for k in range(700)]
    convs = {1: log, 2: log[:300], 3: log[:699], 4: log[1:5], 5: log[:1], 6: [*log[:20], ("user", "other")], 7: log}
    rows = [(c, k, *t) for c, turns in convs.items() for k, t in enumerate(turns)]
    r.shuffle(rows)
    out = defaultdict(dict)
    for x in got(chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7))):
        out[x["conv_id"]][x["part"]] = x["rendered"]
    assert {c: "".join(parts[k] for k in sorted(parts)) for c, parts in out.items()} == {c: "".join(f"<|im_start|>{a}\n{b}<|im_end|>\n" for a, b in convs[c]) for c in (1, 4, 6)}
    assert sorted(out[1]) == [0, 1, 2]


def removed(rows, n):
    """Brute force over rows in the order of their ids; rows that are equal in id and text are one document."""
    seen, out = set(), {}
    for i, t in sorted(set(rows), key=lambda r: (r[0] is None, r[0], r[1])):
        w = WORD.findall(t)
        gone = set()
        for k in range(len(w) - n + 1):
            window = tuple(w[k : k + n])
            if window in seen:
                gone |= set(range(k, k + n))
            seen.add(window)
        out[i, t] = " ".join(x for k, x in enumerate(w) if k not in gone), len(w), len(gone)
    return out


@pytest.mark.parametrize("name", ["docs", "odd", "empty"])
def test_substrings(tables, name):
    df = tables[name]
    expected = removed(texts(df), 20)
    out = got(substrings.without_repeats(df, words=20))
    assert Counter((r["doc_id"], r["kept_text"], r["n_words"], r["n_removed"]) for r in out) == Counter((i, *expected[i, t]) for i, t in texts(df))


def test_substrings_in_split_groups(odd, docs):
    """Groups of few rows are lengthened and split, and every anchor but the rarest counts as heavy."""
    for df in (odd, docs):
        expected = removed(texts(df), 20)
        for rows, share in ((2, 4096), (3, 1_000_000)):
            out = got(substrings._cut(df, "doc_id", "text", 20, rows, share))
            assert Counter((r["doc_id"], r["__kept_text"], r["__n_words"], r["__n_removed"]) for r in out) == Counter((i, *expected[i, t]) for i, t in texts(df))


@pytest.mark.parametrize("mask", [0, 3, (1 << 64) - 1])
def test_substrings_with_colliding_hashes(monkeypatch, mask):
    """Hashes only deal suffixes out: with 1, 4 or all of their values the same words are found to repeat."""
    import pyarrow as pa

    from quire.llm import words

    plain = words.mix
    for module in (words, substrings):
        monkeypatch.setattr(module, "mix", lambda h: plain(h) & np.uint64(mask))
    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in rng.integers(0, 9, 400)]
    rows = []
    for i in range(30):
        a, b = sorted(rng.integers(0, 400, 2))
        rows.append((i, " ".join([*base[a:b], *(f"x{k}" for k in rng.integers(0, 3, 5)), *base[:25], f"own{i}"])))
    t = words.Texts(pa.array([x for _, x in rows]))
    h = np.arange(len(rows), dtype=np.int64) << 40
    for known in ([], ["w1", "w2", "own3", "x1"]):
        for group_rows in (4, 1000):
            spots = [np.arange(n, dtype=np.int64) | (np.int64(9) << 32) for n in t.counts]  # every place counts as one that repeats
            b = substrings._suffixes(t, pa.array(range(len(rows)), pa.int64()), h, spots, 20, (np.zeros(0, np.uint64), np.zeros(0, np.int64)), substrings.Dictionary(known), group_rows)
            for _ in range(2):
                b = pa.concat_tables([pa.Table.from_batches([x]) for x in substrings._trees(20)(iter([b.sort_by("key")]))]).combine_chunks().to_batches()[0]
            gone = defaultdict(set)
            for r in b.to_pylist():
                if r["words"] is None:
                    gone[r["id"]] |= set(range(r["start"], r["start"] + r["n"] + 19))
            assert {i: len(gone[i]) for i, _ in rows} == {i: v[2] for (i, _), v in removed(rows, 20).items()}


def test_quality(tables, spark, data):
    labels = spark.read.parquet(f"{data}/labels.parquet")
    rules = quality.learn_rules(tables["docs"], labels)
    assert quality.learn_rules(tables["docs"], labels.limit(0)) == []
    for df in tables.values():
        expected = Counter()
        for i, t in texts(df):
            w = WORD.findall(t)
            lines = [s for s in t.split("\n") if WORD.search(s)]
            grams = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
            twice = {k + j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(3)}
            expected[i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(twice), len(w) < 50 or 100 * len(twice) > 50 * len(w)] += 1
        out = got(quality.judge(df, rules))
        assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in out) == expected
        assert not any(r["kept"] and r["base_failed"] for r in out)


def test_learned_rules_name_what_they_should():
    rng = np.random.default_rng(0)
    x = {"a": rng.random(900), "b": rng.random(900)}
    bad = (x["a"] > 0.7) & (x["b"] < 0.5)
    rules = quality.learn(x, bad)
    covered = np.zeros(900, bool)
    for r in rules:
        covered |= quality._covers(r, x, 900)
    assert (covered == bad).mean() > 0.97


def test_nearest(spark, data):
    df = spark.read.parquet(f"{data}/embeddings.parquet")
    have = {r.vec_id: np.array(r.embedding, dtype=float) for r in df.collect()}
    out = defaultdict(list)
    for r in sorted(got(ann.search(df, F.col("id") % 20 == 0)), key=lambda r: (r["query_id"], r["rank"])):
        out[r["query_id"]].append(r)
    hit = total = 0
    for q in (i for i in have if i % 20 == 0):
        best = sorted(((-float(have[q] @ v), i) for i, v in have.items() if i != q))[:20]
        assert [r["rank"] for r in out[q]] == list(range(1, len(best) + 1))
        assert all(abs(r["score"] - have[q] @ have[r["vec_id"]]) < 1e-12 for r in out[q])
        hit, total = hit + len({i for _, i in best} & {r["vec_id"] for r in out[q]}), total + len(best)
    assert hit >= 0.9 * total


def test_nearest_of_odd_vectors(spark):
    rows = [(0, [1.0, 0.0, 0.0]), (1, [2.0, 0.0, 0.0]), (2, None), (3, [0.0, 0.0, 0.0]), (4, [float("nan"), 1.0, 0.0]), (5, [1.0, None, 0.0]), (6, [1.0, 0.0]), (None, [1.0, 1.0, 1.0]), (7, [float("inf"), 0.0, 1.0])]
    rows += [(100 + i, [0.5, 0.5, 0.0]) for i in range(40)] + [(20, [0.5, 0.5, 0.0])] * 2
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit(1))
    out = defaultdict(list)
    for r in sorted(got(ann.search(df, F.col("id").isin(0, 20), k=5, recall=1.0)), key=lambda r: (r["query_id"], r["rank"])):
        out[r["query_id"]].append(r["vec_id"])
    assert out == {0: [1, 20, 100, 101, 102], 20: [1, 0, 100, 101, 102]}
    assert got(ann.search(df.limit(0), F.col("id") == 0)) == []


def test_nearest_fills_up_short_answers(spark):
    """Fewer candidates than k at the default recall: every query gets them all, exactly."""
    rng = np.random.default_rng(3)
    have = {i: v for i, v in enumerate(rng.normal(size=(15, 24)))}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in have.items()], "vec_id long, embedding array<double>")
    out = defaultdict(list)
    for r in sorted(got(ann.search(df, F.col("id") % 2 == 0)), key=lambda r: (r["query_id"], r["rank"])):
        out[r["query_id"]].append(r["vec_id"])
    assert out == {q: sorted((i for i in have if i != q), key=lambda i: -float(have[q] @ have[i])) for q in have if q % 2 == 0}


def test_nearest_of_a_query_far_from_all(spark):
    """If few buckets are probed, the query that points elsewhere meets too few candidates and is filled up, exactly."""
    rng = np.random.default_rng(4)
    base = rng.normal(size=64)
    have = {i: base + 0.05 * rng.normal(size=64) for i in range(400)} | {1000: -base + rng.normal(size=64)}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in have.items()], "vec_id long, embedding array<double>")
    out = got(ann.search(df, F.col("id") % 20 == 0, recall=0.01))
    counts = Counter(r["query_id"] for r in out)
    assert counts == {q: 20 for q in have if q % 20 == 0}
    best = sorted((i for i in have if i != 1000), key=lambda i: -float(have[1000] @ have[i]))[:20]
    assert [r["vec_id"] for r in sorted(out, key=lambda r: r["rank"]) if r["query_id"] == 1000] == best


def test_nearest_of_many(spark):
    """Recall on queries that the number of probes was not fitted on, and the share of rows that is scored for it."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(30_000, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(8)
    hasher = ann.Hasher(64)
    probes = ann.fitted_probes(df.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), hasher, F.col("id") % 20 == 0, 20, 0.96)
    sample = {r.id for r in spark.range(0, 30_000, 20).orderBy(F.xxhash64("id"), "id").limit(ann.SAMPLE_QUERIES).collect()}
    out = defaultdict(set)
    for r in got(ann.search(df, F.col("id") % 20 == 0)):
        out[r["query_id"]].add(r["vec_id"])
    others = [q for q in range(0, 30_000, 20) if q not in sample]
    s = x[others] @ x.T
    s[np.arange(len(others)), others] = -2
    best = np.argpartition(-s, 20, axis=1)[:, :20]
    assert len(others) == 1500 - ann.SAMPLE_QUERIES and np.mean([len(out[q] & set(b.tolist())) / 20 for q, b in zip(others, best, strict=True)]) >= 0.9
    assert probes * ann.TABLES / hasher.buckets < 0.3


def test_word_hashes_do_not_depend_on_chunks(monkeypatch):
    import pyarrow as pa

    from quire.llm import words

    column = pa.array(["x" * 300 + " y " + "é" * 90, "", None, "a bb ccc", "z" * 64, "w " * 50])
    whole = words.Texts(column).hashes()
    monkeypatch.setattr(words, "CHUNK_BYTES", 16)
    assert (words.Texts(column).hashes() == whole).all() and len(set(whole.tolist())) == 8


def test_hadamard_is_orthogonal():
    x = np.eye(8)
    assert np.allclose(ann.hadamard(x) @ ann.hadamard(x).T, x)


def linked(rows, n, percent):
    """Brute force: (id, set size, component's smallest id)."""
    sets = []
    for _, t in rows:
        w = WORD.findall(t.translate(LOW))
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()})
    root = list(range(len(rows)))

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    members = defaultdict(list)
    for v, (i, _) in enumerate(rows):
        members[find(v)].append(i)
    least = {r: min((i for i in m if i is not None), default=None) for r, m in members.items()}
    return Counter((i, len(sets[v]), least[find(v)], i == least[find(v)]) for v, (i, _) in enumerate(rows))


@pytest.mark.parametrize("name", ["docs", "odd", "empty"])
def test_near_copies(tables, name):
    df = tables[name]
    out = got(minhash.near_copies(df, words=3, percent=85))
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in out) == linked(texts(df), 3, 85)


def test_chains_of_near_copies_in_blocks(spark, monkeypatch):
    """A drifting text: each version is near its neighbours alone. Small blocks make many cells."""
    monkeypatch.setattr(minhash, "BLOCK", 3)
    words = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(40):
        rows.append((i, " ".join(words)))
        words[i * 4 : i * 4 + 4] = [f"v{i}x{k}" for k in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = got(minhash.near_copies(df, words=3, percent=85))
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in out) == linked(rows, 3, 85)


def test_estimate_follows_similarity():
    rng = np.random.default_rng(1)
    shared, a, b = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (800, 100, 100))
    both = [np.unique(np.concatenate([shared, x])) for x in (a, b)]
    ptr = np.cumsum([0] + [len(x) for x in both])
    _, signature, _ = minhash.sketches(np.concatenate(both), ptr)
    agree = int(minhash.equal_minima(signature[0], signature[1]))
    assert abs((agree / minhash.ORDERS - 0.25) / 0.75 - 0.8) < 0.12
    assert minhash.least_equal(0.8) < agree


def test_long_signatures_part_templated_texts(spark):
    """Of pairs that share 70 % of their shingles hardly any go on to be confirmed at 85 %; pairs at 85 % all do."""
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 700, dtype=np.uint64)
    passed = {}
    for shared, own in ((700, 150), (700, 61)):  # similarities 0.7 and 0.852
        sets = [np.unique(np.concatenate([base[:shared], rng.integers(0, 1 << 63, own, dtype=np.uint64)])) for _ in range(60)]
        df = spark.createDataFrame([((k, k), x.view(np.int64).tolist()) for k, x in enumerate(sets)], "node struct<i:long,x:long>, grams array<long>")
        rows = minhash.long_signatures(df).select(F.lit(1).cast("long").alias("g"), "node", F.col("node").alias("comp"), "n", F.lit(0).alias("band"), F.array(F.lit(1).cast("long")).alias("bands"), "signature")
        passed[own] = minhash._alike(minhash._cells(rows), 85).select("node").distinct().count()
    assert passed[150] == 0 and passed[61] == 60


def test_group_of_near_copies_with_many_components(spark):
    """Versions of one text, similar enough to share all buckets, of which about a third of the pairs are links."""
    rng = np.random.default_rng(11)
    rows = []
    for i in range(150):
        w = [f"w{k}" for k in range(150)]
        for k in rng.integers(0, 150, rng.integers(1, 9)):
            w[k] = f"x{rng.integers(0, 10**6)}"
        rows.append((i, " ".join(w)))
    out = got(minhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), words=3, percent=85))
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in out) == linked(rows, 3, 85)


def test_hubs(spark):
    rows = spark.createDataFrame([(k, i) for k, n in ((1, 50), (2, 3), (3, 1), (None, 4)) for i in range(n)], "u long, v long")
    least = rows.where("u < 3").groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("k"))
    assert Counter((r["u"], r["m"]) for r in got(components.joined_back(rows, least, "u"))) == {(1, 0): 50, (2, 0): 3}
    star = spark.createDataFrame([(7, i) for i in range(20, 90)] + [(89, 100), (5, 6)], "a long, b long")
    assert {r["node"]: r["root"] for r in got(components.connected(star))} == {**{i: 7 for i in [7, *range(20, 90), 100]}, 5: 5, 6: 5}


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 60), (60, 50), (70, 70), (None, 3)], "a long, b long")
    out = {r["node"]: r["root"] for r in got(components.connected(edges))}
    assert out == {**{i: 0 for i in range(31)}, 50: 50, 60: 50}
    assert got(components.connected(edges.limit(0))) == []


def test_targets_of_many_sources(spark):
    """As many sources as documents: ranks and the water level by plain loops."""
    rng = np.random.default_rng(9)
    sizes = {f"s{i:03}": int(n) for i, n in enumerate(rng.integers(0, 400, 300))}
    df = spark.createDataFrame([*sizes.items(), (None, 50)], "source string, size long")
    order = [*sorted(sizes), None]
    size, weight = {**sizes, None: 50}, {s: 1 + i % 3 for i, s in enumerate(order)}
    total, open_, fixed = sum(size.values()), set(order), {}
    while True:  # those beyond three times their size stop there, the rest share what is left
        level = (total - sum(fixed.values())) / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level >= 3 * size[s]}
        if not full:
            break
        fixed |= {s: 3.0 * size[s] for s in full}
        open_ -= full
    out = {r.source: r for r in mixing.source_targets(df.repartition(5), (1, 2, 3), 3).collect()}
    assert all(out[s].sid == i + 1 for i, s in enumerate(order))
    assert all(abs(out[s].target - fixed.get(s, weight[s] * level)) < 1e-6 for s in order)


def test_mix(same, spark, odd):
    same(entry.op9_weighted_mix, mixing.ORACLE_SQL)
    out = got(mixing.plan_mix(odd))
    assert len(out) == len(ROWS) and all(r["taken"] in {r["size"] * k for k in range(4)} for r in out)
    assert Counter((r["doc_id"], r["size"]) for r in out) == Counter((i, len(WORD.findall(t))) for i, t in texts(odd))
    assert got(mixing.plan_mix(odd.limit(0))) == []
    assert mixing.mixed(odd).columns == odd.columns


def test_languages(docs, odd):
    marked = docs.withColumn("held_out", F.crc32(F.col("doc_id").cast("string")) % 4 == 2)
    model = langid.train(marked.where("NOT held_out"))
    out = got(langid.identify(marked.where("held_out"), model))
    assert np.mean([r["lang"] == r["lang_pred"] for r in out]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in out)
    got_odd = got(langid.identify(odd, model))
    assert len(got_odd) == len(ROWS) and {r["doc_id"] for r in got_odd if r["lang_pred"] == "und"} == {1, 2, 3, 12}
    none = langid.train(docs.limit(0))
    assert {r["lang_pred"] for r in got(langid.identify(odd, none))} == {"und"}


def test_letters_are_what_isalpha_says(docs):
    samples = ["½ ② ①", "Ⅻ", "١٢", "_", "5 €", "é", "日本", "x½", "ªº", "\u0301", "漢字 一"]
    model = langid.train(docs)
    for t in samples:
        assert bool(langid.folded(t)) == any(c.isalpha() for c in t.lower())
        assert (model.predict([t])[0][0] == "und") == (not any(c.isalpha() for c in t))


def test_kernel_ridge_by_brute_force():
    """The kernel over sets of n-gram buckets, the Nystroem map and the ridge solution, one number at a time."""
    train = ["the cat sat on the mat", "a dog and the cat", "der hund und die katze", "die maus ist im haus", "le chat est sur la table", "le chien dort"]
    langs = ["en", "en", "de", "de", "fr", "fr"]
    model = langid.fit(train, langs, landmarks=6, ridge=0.5)
    sets = lambda t: set(np.flatnonzero(langid.presence([t])[0]).tolist())
    kernel = lambda a, b: len(sets(a) & sets(b)) / np.sqrt(len(sets(a)) * len(sets(b)))
    order = [2, 0, 4, 3, 1, 5]  # landmarks: in turn from de, en, fr
    marks = [train[i] for i in order]
    k = np.array([[kernel(a, b) for b in marks] for a in marks])
    w, v = np.linalg.eigh(k)
    root = v @ np.diag(w**-0.5) @ v.T
    phi = lambda t: np.append(root @ np.array([kernel(t, m) for m in marks]), 1.0)
    x = np.array([phi(t) for t in train])
    y = np.array([[1.0 if n == c else -1.0 for c in ("de", "en", "fr")] for n in langs])
    solved = np.linalg.solve(x.T @ x + np.diag([0.5 * 6 / 100] * 6 + [0.0]), x.T @ y)
    for t in ["the dog", "die katze", "la table", "xyz the"]:
        value = phi(t) @ solved
        lang, score = model.predict([t])
        assert lang[0] == ("de", "en", "fr")[int(value.argmax())] and abs(score[0] - np.clip((value.max() + 1) / 2, 0, 1)) < 1e-4


def test_language_stage_drops_what_no_language_holds(spark, docs, data):
    """However many languages are learned and however long the text; labels of junk do not help it."""
    import base64
    import random

    import corpus_pipeline

    r = random.Random(1)
    letters = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz  ") for _ in range(n))
    junk = [letters(40), letters(3000), letters(100_000), base64.b64encode(r.randbytes(900)).decode(), "これは日本語の文章です。" * 9, "Это русский текст о погоде", "for (int i = 0; i < n; i++) { sum += arr[i] * vec[j]; }"]
    clean = [x.text for x in docs.where("lang = 'en' AND text IS NOT NULL").orderBy("doc_id").limit(60).collect()]
    long = " ".join(clean)
    assert len(long) > 100_000
    rows = [(-1 - i, t, "en", "junk", len(t)) for i, t in enumerate(junk)] + [(-100, long, "en", "long", len(long))]
    more = docs.unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").select(*[F.col(c).cast(docs.schema[c].dataType) for c in docs.columns]))
    for some in (more, more.where("lang IN ('en', 'fr')")):
        whole = {x.doc_id for x in some.where("text rlike '[a-zA-Z]' AND (doc_id >= 0 OR doc_id = -100)").collect()}
        assert {x.doc_id for x in corpus_pipeline.language(spark, some, data).collect()} == whole


def test_pipeline(spark, data, tmp_path, odd):
    import corpus_pipeline

    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, lib = docs.columns, bpe.library(entry.tokenizer("word_bpe_49k.json"))
    before = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, before, data).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        assert after.columns == columns
        if k == 1:
            kept = {i for i, _, _, ok in linked(texts(before), 5, 80) if ok}
            assert {r.doc_id for r in after.collect()} == kept
        if k == 2:
            plain = removed(texts(before), corpus_pipeline.PASSAGE_WORDS)
            assert {r.doc_id: (r.text or "").split() for r in after.collect()} == {i: v[0].split() for (i, _), v in plain.items()}
        before = after
    out = got(corpus_pipeline.encode(spark, before, data))
    assert Counter((r["doc_id"], hashlib.sha256(bytes(r["ids"])).hexdigest()) for r in out) == Counter((i, hashlib.sha256(np.array(lib.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes()).hexdigest()) for i, t in texts(before))


def test_pipeline_keeps_users_columns(spark, data, odd):
    """Columns that are named as the operators name theirs come out of every stage as they went in."""
    import corpus_pipeline

    more = {c: F.concat(F.lit(f"{c} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for c in ("lang_pred", "score", "n_words", "n_removed", "kept_text", "component_id", "kept", "taken", "size", "target", "id", "key")}
    small = odd.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars")).withColumns(more)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, small, data)
        assert after.schema.names == small.schema.names and [f.dataType for f in after.schema] == [f.dataType for f in small.schema]
        out = got(after)
        assert out and all(r[c] == f"{c} of {'none' if r['doc_id'] is None else r['doc_id']}" for r in out for c in more)
        small = spark.createDataFrame([tuple(r[c] for c in small.columns) for r in out], small.schema)
    assert corpus_pipeline.encode(spark, small, data).columns == ["doc_id", "n_tokens", "ids", "decoded"]


def test_pipeline_of_nothing(spark, data, odd):
    import corpus_pipeline

    none = odd.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars")).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert got(stage(spark, none, data)) == []


def test_language_stage_by_brute_force(spark, docs, data):
    """Shares of 4-letter sequences as texts, not hashes, over the texts that the stage learns from."""
    import corpus_pipeline

    def grams(t):
        x = f" {langid.folded(t)}  "
        return [x[i : i + 4] for i in range(len(x) - 3)] if langid.folded(t) else []

    more = docs.unionByName(docs.where("lang = 'en'").limit(20).withColumns({"doc_id": (F.col("doc_id") + 10**6).cast(docs.schema["doc_id"].dataType), "text": F.translate("text", "abcdefghijklmnopqrstuvwxyz", "qxzjvkwybgpfmucldhrsnitoae")}))
    by = defaultdict(list)
    for r in langid.training_rows(more).collect():
        if langid.folded(r.text):
            by[r.lang].append(grams(r.text))
    usual = lambda t: {g for g, n in Counter(t).items() if n * langid.EVERY >= len(t)}
    held = {v: {g for g, n in Counter(g for t in each for g in usual(t)).items() if n > 1} for v, each in by.items()}
    share = lambda t, v: sum(g in held[v] for g in t) / len(t) if t else 0.0
    floor = {v: langid.ACCEPTED * np.median([share(t, v) for t in each]) for v, each in by.items()}
    expected = {i for i, t in texts(more) if grams(t) and any(share(grams(t), v) >= floor[v] for v in by)}
    assert {r.doc_id for r in corpus_pipeline.language(spark, more, data).collect()} == expected


def test_language_stage_without_languages_keeps_all_letters(spark, docs, odd, data):
    """Where no row has a lang there is nothing to learn; that leaves no text with a letter out."""
    import corpus_pipeline

    for df in (docs, odd):
        none = df.withColumn("lang", F.lit(None).cast("string"))
        expected = Counter((i, t) for i, t in texts(none) if langid.folded(t))
        assert expected and Counter(texts(corpus_pipeline.language(spark, none, data))) == expected


def test_what_the_language_stage_drops_counts_nowhere_later(spark, docs, data):
    """A passage that only junk has had before stays in a good text, and the mix is another one."""
    import random

    import corpus_pipeline

    r = random.Random(3)
    words = " ".join(t for i, t in sorted(texts(docs.where("lang = 'en'"))) if i % 7 == 0).split()
    passage, own = " ".join(r.sample(words, 60)), " ".join(r.sample(words, 200))
    junk = "".join(r.choice("bcdfghjklmnpqrstvwxz ") for _ in range(30_000))
    rows = [(-1, f"{junk} {passage}", "en", "a junk"), (10**6, f"{own} {passage}", "en", "src1")]
    rows = spark.createDataFrame([(i, t, v, s, len(t)) for i, t, v, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    more = docs.unionByName(rows.select(*[F.col(c).cast(docs.schema[c].dataType) for c in docs.columns]))
    cut, mixed = [], []
    for x in (checkpointed(corpus_pipeline.language(spark, more, data)), more):
        x = checkpointed(corpus_pipeline.near_copies(spark, x, data))
        x = checkpointed(corpus_pipeline.repeated_passages(spark, x, data))
        cut.append({i: t for i, t in texts(x) if i in (-1, 10**6)})
        mixed.append(Counter(texts(corpus_pipeline.mix(spark, x, data))))
    assert cut[0] == {10**6: f"{own} {passage}"} and cut[1].keys() == {-1, 10**6} and passage not in cut[1][10**6]
    # the mix of the other rows changes too
    assert {k: n for k, n in mixed[0].items() if k[0] not in (-1, 10**6)} != {k: n for k, n in mixed[1].items() if k[0] not in (-1, 10**6)}


def test_mix_stage_by_sql(spark, docs, data):
    """The rows that the stage sends, as often as the SQL of the mixing plan says."""
    import corpus_pipeline
    import duckdb

    part = docs.where("doc_id % 3 > 0")
    con = duckdb.connect()
    con.register("documents", part.toPandas())
    expected = Counter({i: k // n for i, n, k in con.execute(f"SELECT doc_id, size, taken FROM ({mixing.ORACLE_SQL}) WHERE taken > 0").fetchall()})
    assert Counter(r.doc_id for r in corpus_pipeline.mix(spark, part, data).collect()) == expected


def test_entry_functions(spark, data, docs):
    """What each query derives from its operator's output."""
    import zlib

    sha = lambda x: hashlib.sha256(x).hexdigest()
    by = dict(texts(docs))
    out = {k: {r["doc_id"]: r for r in got(entry.queries()[n](spark, data))} for k, n in ((1, "op1_license_scan"), (2, "op2_bpe_roundtrip"), (4, "op4_token_counts"), (5, "op5_substring_dedup"), (6, "op6_quality_rules"), (8, "op8_near_copies"), (9, "op9_weighted_mix"), (10, "op10_language_id"))}
    assert all(set(v) == set(by) for v in out.values())
    words, counts = bpe.library(entry.tokenizer("word_bpe_49k.json")), bpe.library(entry.tokenizer("byte_bpe_50k.json"))
    cut = removed(texts(docs), 20)
    components = {i: c for i, _, c, _ in linked(texts(docs), 3, 85)}
    model = langid.train(docs.where("crc32(cast(doc_id AS string)) % 4 <> 2"))
    rules = quality.learn_rules(docs, spark.read.parquet(f"{data}/labels.parquet"))
    kept = {r.doc_id: r.kept for r in quality.judge(docs, rules).collect()}
    for i, t in by.items():
        ids = words.encode(t, add_special_tokens=False).ids
        r = out[2][i]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(np.array(ids, dtype="<u4").tobytes()), sha(words.decode(ids, skip_special_tokens=False).encode()))
        n = len(counts.encode(t, add_special_tokens=False).ids)
        assert (out[4][i]["n_tokens"], out[4][i]["over_limit"], out[4][i]["n_bytes"]) == (n, n > 1024, len(t.encode()))
        assert (out[5][i]["n_removed"], out[5][i]["kept_sha256"]) == (cut[i, t][2], sha(cut[i, t][0].encode()))
        assert (out[8][i]["component_id"], out[8][i]["kept"]) == (components[i], components[i] == i)
        assert out[9][i]["size"] == len(WORD.findall(t)) and out[6][i]["kept"] == kept[i]
        assert out[10][i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and out[10][i]["lang_pred"] == model.predict([t])[0][0]
    near = got(entry.queries()["op7_nearest_neighbours"](spark, data))
    assert {r["query_id"] % 20 for r in near} == {0} and Counter(r["query_id"] for r in near).most_common()[-1][1] == 20


def test_verdict_of_learned_rules(spark, docs, data):
    """kept, by the rules asked one after the other on plain numbers."""
    rules = quality.learn_rules(docs, spark.read.parquet(f"{data}/labels.parquet"))
    assert rules
    for r in quality.judge(docs, rules).collect():
        x = {f: r[of] / (max(r[by], 1) if by else 1) for f, (of, by) in quality.FEATURES.items()}
        named = any(all((x[c.feature] >= c.threshold) == c.above for c in rule) for rule in rules)
        assert r.kept == (not r.base_failed and not named)


def test_all_are_registered():
    known = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in known) for k in range(1, 14)) and "pipeline" in known
