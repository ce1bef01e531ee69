"""Stored postings and vectors, pages of a total order, questions as a graph, pages as markdown: against plain Python."""

import html
import itertools
import json
import math
import random
import re
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions.stem import stem
from quire.operators import ask, postings, ranges, search, validation, vectors, writes
from quire.plans import sqlfunctions
from quire.sources.markdown import to_markdown

# postings

WORDS = "river stone bridge rivers Bridges bridging running ran runs camelCase x1y water deep ÄRGER".split()
SCHEMA = "field string, id string, parent string, title string, text string"


def some_rows(r, ids, fields=("body", "head")):
    """Lengths and counts vary, some texts are null or empty, some parents are shared or missing."""
    out = []
    for f, i in itertools.product(fields, ids):
        n = r.choice([0, 1, 3, 8, 30])
        text = None if r.random() < 0.05 else " ".join(r.choices(WORDS, weights=[9, 8, 7, 5, 4, 3, 3, 2, 2, 1, 1, 1, 1, 1], k=n))
        out.append((f, f"{i}", None if r.random() < 0.05 else f"p{int(i) // 2}", f"title {int(i) // 2}", text))
    return out


def plain_tokens(text):
    x = re.sub(r"(?<=[a-zäöü])(?=[A-ZÄÖÜ])|(?<=[^\W\d_])(?=\d)|(?<=\d)(?=[^\W\d_])", " ", text)
    return re.findall(r"[^\W_]+", x.lower())


def scanned(alive, query, k, stemmed, fields=None):
    of = stem if stemmed else (lambda w: w)
    terms = list(dict.fromkeys(map(of, plain_tokens(query))))
    best = {}
    for field in {f for f, _ in alive} if fields is None else fields:
        docs = {i: (row, list(map(of, plain_tokens(row[4])))) for (f, i), row in alive.items() if f == field and row[4] is not None}
        if not docs:
            continue
        mean = sum(len(w) for _, w in docs.values()) / len(docs)
        df = {t: sum(t in w for _, w in docs.values()) for t in terms}
        for row, w in docs.values():
            if all(t in w for t in terms) and row[2] is not None:
                s = sum(math.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5)) * w.count(t) * 2.2 / (w.count(t) + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t in terms)
                key = (row[2], row[3])
                best[key] = max(best.get(key, 0), s)
    return [(p, t, round(s, 9)) for (p, t), s in sorted(best.items(), key=lambda x: (-round(x[1], 9), x[0]))][:k]


def found(df):
    return [(r.id, r.title, round(r.relevance, 9)) for r in df.collect()]


@pytest.mark.parametrize("stemmed", [False, True])
def test_postings_equal_a_scan_through_changes(spark, tmp_path, monkeypatch, stemmed):
    monkeypatch.setattr(postings, "BLOCK", 8)
    monkeypatch.setattr(postings, "FIRST", 2)
    r, folder, alive = random.Random(5), str(tmp_path / "a"), {}
    queries = [("river", 3), ("Bridge river", 5), ("running water", 40), ("camelCase", 9), ("nosuchword river", 4), ("x1y", 2)]
    for step, ids in enumerate([range(60), range(40, 75), None, range(5)]):
        rows = some_rows(r, ids) if ids is not None else None
        gone = {(f, f"{i}") for f in ("body", "head") for i in r.sample(range(75), 9)} if step else set()
        if rows is not None:
            gone -= {(row[0], row[1]) for row in rows}
        removed = spark.createDataFrame(sorted(gone), "field string, id string") if gone else None
        assert postings.add(spark.createDataFrame(rows, SCHEMA) if rows is not None else None, folder, spark, removed, stemmed=stemmed, buckets=3) == step
        alive = {k: v for k, v in alive.items() if k not in gone} | {(row[0], row[1]): row for row in rows or []}
        if step in (1, 3):
            for q, k in queries:
                assert found(postings.search(spark, folder, q, k)) == scanned(alive, q, k, stemmed), (step, q)
    assert found(postings.search(spark, folder, "river", 5, ["head"])) == scanned(alive, "river", 5, stemmed, ["head"])
    postings.merged(folder, str(tmp_path / "b"), spark)
    assert found(postings.search(spark, str(tmp_path / "b"), "Bridge river", 5)) == scanned(alive, "Bridge river", 5, stemmed)
    assert postings.Index(spark, str(tmp_path / "b")).table("gone").count() == 0
    sqlfunctions.register_text_search(spark, folder, "find_here")
    assert found(spark.sql("SELECT * FROM find_here(concat('Bridge', ' river'), 5)")) == scanned(alive, "Bridge river", 5, stemmed)


def test_segment_that_was_not_finished_does_not_exist(spark, tmp_path, monkeypatch):
    folder, write = str(tmp_path), postings._write
    first = [("f", "1", "p1", "t", "river stone"), ("f", "2", "p2", "t", "river")]
    postings.add(spark.createDataFrame(first, SCHEMA), folder, spark)

    def dying(df, where, name, segment, by=None):
        if name == "segments":
            raise OSError("gone")
        write(df, where, name, segment, by)

    monkeypatch.setattr(postings, "_write", dying)
    with pytest.raises(OSError):
        postings.add(spark.createDataFrame([("f", "2", "p2", "t", "river river river")], SCHEMA), folder, spark)
    alive = {(x[0], x[1]): x for x in first}
    assert found(postings.search(spark, folder, "river", 5)) == scanned(alive, "river", 5, True)
    monkeypatch.setattr(postings, "_write", write)
    new = ("f", "2", "p2", "t", "stone stone river")
    assert postings.add(spark.createDataFrame([new], SCHEMA), folder, spark) == 1
    assert found(postings.search(spark, folder, "river", 5)) == scanned(alive | {("f", "2"): new}, "river", 5, True)


def test_blocks_of_low_bounds_are_skipped_and_no_text_is_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "BLOCK", 16)
    r = random.Random(3)
    rows = [("f", f"{i}", f"{i}", None, " ".join(["brook"] + ["river"] * (1 + (i % 97 == 0) * 6) + ["filler"] * r.randrange(5, 400))) for i in range(1500)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # ranges of small tables stay apart
    try:
        postings.add(spark.createDataFrame(rows, SCHEMA), str(tmp_path), spark)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    index = postings.Index(spark, str(tmp_path))
    all_, worth, least = postings.candidates(index, "river", 5)
    assert least > 0 and worth.count() < 0.5 * all_.count()
    df = postings.search(spark, str(tmp_path), "river", 5)
    assert found(df) == scanned({(x[0], x[1]): x for x in rows}, "river", 5, True)
    assert "text" not in {c for f in df.inputFiles() for c in spark.read.parquet(f).columns}
    df = postings.search(spark, str(tmp_path), "brook", 5)  # the shortest texts
    assert found(df) == scanned({(x[0], x[1]): x for x in rows}, "brook", 5, True)
    _, worth, _ = postings.candidates(index, "brook", 5)
    parts = worth.select(postings._part(f"block * {postings.BLOCK}")).distinct().count()
    assert parts < index.table("docs").select("part").distinct().count()
    assert re.search(r"PartitionFilters: \[[^\]]*part#\d+ (=|IN)", df._jdf.queryExecution().toString())


def test_nothing_is_found_in_nothing(spark, tmp_path):
    assert postings.search(spark, str(tmp_path / "none"), "river", 5).collect() == []
    postings.add(spark.createDataFrame([("f", "1", "p", "t", None), ("f", None, "p", "t", "river")], SCHEMA), str(tmp_path / "a"), spark)
    assert postings.search(spark, str(tmp_path / "a"), "river", 5).collect() == []


def test_highlight_follows_the_search(spark):
    texts = ["Running rivers, RUN!", "camelRun run2 ärger Ärger", None, "", "``run`` runs'run", "rerun pruning"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.highlight for r in search.highlight(df, "t", "run").collect()]
    assert got == ["`Running` rivers, `RUN`!", "camel`Run` `run`2 ärger Ärger", None, "", "```run``` `runs`'`run`", "rerun pruning"]
    got = [r.highlight for r in search.highlight(df, "t", "ÄRGER run", stemmed=False).collect()]
    assert got == ["Running rivers, `RUN`!", "camel`Run` `run`2 `ärger` `Ärger`", None, "", "```run``` runs'`run`", "rerun pruning"]
    marked = search.highlight(df.where("t IS NOT NULL"), "t", "run").select("t", F.replace("highlight", F.lit("`"), F.lit("")).alias("h"))
    assert marked.where(F.replace("t", F.lit("`"), F.lit("")) != F.col("h")).count() == 0


def test_references_of_a_long_text(spark):
    r = random.Random(2)
    parts = [r.choice([f"source:a{r.randrange(400)}", f"[note:b{r.randrange(50)}]", "plain words", "[[source_insight:c1]]", "source: none"]) for _ in range(3000)]
    text = " ".join(parts)
    keys = [(m.start(), m.end(), m.group()) for m in re.finditer(r"(?:source_insight|note|source):[a-zA-Z0-9_]+", text)]
    row = spark.createDataFrame([(text,)], "t string").select(T.citations(F.col("t")).alias("c"), T.numbered_citations(F.col("t")).alias("n")).first()
    assert [(c.start, c.end, c.key) for c in row.c] == keys and all(f"{c.type}:{c.id}" == c.key for c in row.c)
    order = list(dict.fromkeys(k for _, _, k in keys))
    link = lambda m: f"[{order.index(m.group(1)) + 1}](#ref-{m.group(1).replace(':', '-')})"
    one = r"((?:source_insight|note|source):[a-zA-Z0-9_]+)"
    body = re.sub(rf"\[\[{one}\]\]|\[{one}\]|{one}", lambda m: link(re.search(one, m.group())), text)
    assert row.n == body + "\n\nReferences:\n" + "\n".join(f"[{i}] - [{k}](#ref-{k.replace(':', '-')})" for i, k in enumerate(order, 1))


# vectors

def clustered(seed=1, clusters=40, each=120, dims=16):
    g = np.random.default_rng(seed)
    centres = g.normal(size=(clusters, dims))
    x = np.repeat(centres, each, 0) + 0.15 * g.normal(size=(clusters * each, dims))
    return x * g.uniform(0.1, 9, size=(len(x), 1))


def scan_vectors(rows, q, k, least):
    q = np.array(q)
    sims = []
    for i, v in rows:
        if v is not None and len(v) == len(q) and all(c is not None and math.isfinite(c) for c in v) and any(v):
            s = float(np.dot(v, q) / math.sqrt(np.dot(v, v) * np.dot(q, q)))
            if s >= least:
                sims.append((-round(s, 9), i))
    return [(i, -s) for s, i in sorted(sims)[:k]]


def test_stored_vectors_equal_a_scan(spark, tmp_path):
    x = clustered()
    rows = [(f"v{i:05}", [float(c) for c in v]) for i, v in enumerate(x)]
    rows += [("copy", rows[7][1]), ("double", [2 * c for c in rows[7][1]]), ("null", None), ("zero", [0.0] * 16), ("short", [1.0] * 3), ("nan", [float("nan")] * 16), ("hole", [None] + [1.0] * 15), ("empty", [])]
    vectors.write(spark.createDataFrame(rows, "id string, embedding array<double>"), str(tmp_path), 16)
    shares = []
    for q, k, least in [(rows[7][1], 5, -1.0), (rows[2000][1], 30, 0.5), ([1.0] * 16, 10, -1.0), (rows[99][1], 500, -1.0), (rows[3][1], 10, 0.999999)]:
        got = [(r.id, round(r.similarity, 9)) for r in vectors.nearest(spark, str(tmp_path), q, k, least).collect()]
        assert got == scan_vectors(rows, q, k, least)
        all_, worth, _ = vectors.plan(spark, str(tmp_path), q, k, least)
        shares.append(worth.agg(F.sum("n")).first()[0] / all_.agg(F.sum("n")).first()[0])
    assert shares[0] < 0.3 and shares[1] < 0.3, shares


def test_stored_vectors_of_nothing(spark, tmp_path):
    vectors.write(spark.createDataFrame([("zero", [0.0, 0.0])], "id string, embedding array<double>"), str(tmp_path), 2)
    assert vectors.nearest(spark, str(tmp_path), [1.0, 0.0], 3).collect() == []


def test_many_queries_in_blocks(spark):
    g = np.random.default_rng(4)
    rows = [(f"v{i}", [float(c) for c in v]) for i, v in enumerate(np.round(g.normal(size=(300, 4))))] + [("none", None), ("short", [1.0]), ("again", [1.0, 0.0, 0.0, 0.0])]
    queries = [(f"q{i}", [float(c) for c in v]) for i, v in enumerate(g.normal(size=(17, 4)))] + [("qz", [0.0] * 4), ("qn", None), ("q1d", [2.0])]
    got = vectors.nearest_of_many(spark.createDataFrame(queries, "query string, vector array<double>"), spark.createDataFrame(rows, "id string, embedding array<double>"), 6, 0.1, at_once=5)
    by = {}
    for r in got.collect():
        by.setdefault(r.query, []).append((-round(r.similarity, 9), r.id))
    for name, q in queries:
        assert [(i, -s) for s, i in sorted(by.get(name, []))] == (scan_vectors(rows, q, 6, 0.1) if q and any(q) else [])


# a total order in ranges

def test_pages_and_places(spark, tmp_path):
    r = random.Random(1)
    rows = [(i, r.choice([None, *range(9)]), r.choice("abc")) for i in range(2000)]
    df = spark.createDataFrame(rows, "id int, a int, b string").repartition(7)
    order = [F.col("a").desc(), F.col("b"), F.col("id")]
    sure = sorted(rows, key=lambda x: (x[1] is None, -(x[1] or 0), x[2], x[0]))
    assert [tuple(x) for x in ranges.numbered(df, order).orderBy("n").select("id", "a", "b").collect()] == sure
    assert [x.n for x in ranges.numbered(df, order).orderBy("n").collect()] == list(range(1, 2001))
    pages = ranges.Pages.write(df, order, str(tmp_path / "p"))
    assert pages.total == 2000
    for offset, limit in [(0, 30), (1234, 50), (1990, 50), (3000, 5), (17, 1900)]:
        assert [tuple(x) for x in pages.rows(offset, limit).collect()] == sure[offset : offset + limit]
    deep = pages.page(30, 50)
    assert len({f.split("__part=")[1].split("/")[0] for f in deep.inputFiles()}) <= 2
    with pytest.raises(ValueError):
        pages.page(0)
    last, got = None, []
    while part := ranges.after(df, [("a", "desc"), ("b", "asc"), ("id", "asc")], last, 333).collect():
        got += [tuple(x) for x in part]
        last = part[-1].asDict()
    assert got == sure
    none = ranges.Pages.write(df.limit(0), order, str(tmp_path / "q"))
    assert none.total == 0 and none.page(1).collect() == []


# asking

def test_questions_without_searches_or_results(spark):
    def plan(questions):
        return [json.dumps({"reasoning": q, "searches": {"none": [], "lost": [{"term": "zero", "instructions": "i"}], "both": [{"term": "zero", "instructions": "i"}, {"term": "one", "instructions": "j"}, {"term": "one", "instructions": "k"}]}[q]}) for q in questions]

    def embed(terms):
        return [[0.0, 0.0] if t == "zero" else [1.0, 0.5] for t in terms]

    def answer(payloads):
        return [f"<think>hm</think>{p['term']} {p['instructions']}: {','.join(p['ids'])}" for p in map(json.loads, payloads)]

    def conclude(payloads):
        return [f"{p['reasoning']}|{len(p['searches'])}|{';'.join(p['answers'])}" for p in map(json.loads, payloads)]

    source = spark.createDataFrame([("s1", "Title")], "id string, title string")
    embedding = spark.createDataFrame([("e1", "s1", "chunk one", [1.0, 0.4]), ("e2", "s1", "chunk two", [1.0, 0.9]), ("e3", "s2", "far", [-1.0, 0.0])], "id string, source string, content string, embedding array<double>")
    insight = spark.createDataFrame([("i1", "s1", "summary", "short", [0.5, 0.5])], "id string, source string, insight_type string, content string, embedding array<double>")
    note = spark.createDataFrame([("n1", "Note", "text", None)], "id string, title string, content string, embedding array<double>")
    questions = spark.createDataFrame([(1, "none"), (2, "lost"), (3, "both"), (4, None)], "question_id int, question string")
    out = {r.question_id: r for r in ask.ask(questions, plan, embed, answer, conclude, source, embedding, insight, note).collect()}
    assert {k: (r.answers, r.final_answer) for k, r in out.items()} == {1: ([], "none|0|"), 2: ([], "lost|1|"), 3: (["one j: s1,i1", "one k: s1,i1"], "both|3|one j: s1,i1;one k: s1,i1")}
    assert [s.ids for s in out[3].searches] == [[], ["s1", "i1"], ["s1", "i1"]]

    def broken(questions):
        return ["no JSON" for _ in questions]

    with pytest.raises(Exception, match="MALFORMED|FAILFAST|parse"):
        ask.ask(questions, broken, embed, answer, conclude, source, embedding, insight, note).collect()


# markdown

class Second(HTMLParser):
    """Another reading of simple pages: events of the standard parser, lines of blocks, no stack of strings."""

    SKIP = {"script", "style", "title"}
    BLOCK = {"p", "div", "article", "nav", "footer", "body", "html", "head"}
    MARK = {"b": "**", "i": "*", "code": "`"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.now, self.skip, self.marks, self.lists, self.rows, self.cell, self.head = [], "", 0, [], [], None, None, 0

    def flush(self, mark=""):
        while self.marks:
            self.handle_endtag(self.marks[-1][0])
        lines = [x.strip(" \t\n\f\r") for x in re.sub("[ \t\n\f\r]*\x01[ \t\n\f\r]*", "\x01", re.sub("[ \t\n\f\r]+", " ", self.now)).split("\x01")]
        while lines and not lines[0]:
            lines.pop(0)
        while lines and not lines[-1]:
            lines.pop()
        if lines:
            self.blocks.append(mark + re.sub(r"\n{3,}", "\n\n", "\n".join(lines)))
        self.now = ""

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        if tag in self.SKIP:
            self.skip += 1
        elif self.skip:
            return
        elif tag == "br":
            self.now += "\x01"
        elif tag in self.BLOCK or re.fullmatch("h[1-6]", tag):
            self.flush()
        elif tag in self.MARK or tag == "a":
            self.marks.append((tag, len(self.now), attrs.get("href")))
        elif tag in ("ul", "ol"):
            self.flush()
            self.lists.append([tag, 0, []])
        elif tag == "table":
            self.flush()
            self.rows = []
        elif tag == "tr":
            self.rows.append([])

    def handle_endtag(self, tag):
        if tag in self.SKIP:
            self.skip -= 1
        elif self.skip:
            return
        elif re.fullmatch("h[1-6]", tag):
            before = len(self.blocks)
            self.flush()
            if len(self.blocks) > before:
                self.blocks[-1] = "#" * int(tag[1]) + " " + self.blocks[-1].replace("\n", " ")
        elif tag in self.BLOCK:
            self.flush()
        elif any(m[0] == tag for m in self.marks):
            name, at, href = self.marks.pop()
            inner = re.sub("[ \t\n\f\r]+", " ", self.now[at:])
            core = inner.strip(" \x01")
            if core:
                left, right = inner[: len(inner) - len(inner.lstrip(" \x01"))], inner[len(inner.rstrip(" \x01")) :]
                around = (f"[{core}]({href})" if href else core) if name == "a" else self.MARK[name] + core + self.MARK[name]
                self.now = self.now[:at] + " " * left.startswith(" ") + around + " " * right.endswith(" ")
        elif tag == "li" and self.lists:
            kind = self.lists[-1]
            kind[1] += 1
            kind[2].append((("- " if kind[0] == "ul" else f"{kind[1]}. ") + re.sub("[ \t\n\f\r]+", " ", self.now).strip(" \t\n\f\r")).rstrip(" "))
            self.now = ""
        elif tag in ("ul", "ol"):
            self.blocks.append("\n".join(self.lists.pop()[2]))
        elif tag in ("td", "th"):
            self.rows[-1].append(re.sub("[ \t\n\f\r\x01]+", " ", self.now).strip(" \t\n\f\r").replace("|", "\\|"))
            self.now = ""
        elif tag == "table":
            width = max(map(len, self.rows))
            lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in self.rows]
            self.blocks.append("\n".join([lines[0], "| " + " | ".join(["---"] * width) + " |", *lines[1:]]))
            self.rows, self.now = None, ""

    def handle_data(self, data):
        if not self.skip:
            self.now += data

    def text(self):
        self.flush()
        return "\n\n".join(self.blocks)


def second(page):
    p = Second()
    p.feed(page)
    p.close()
    return p.text()


def test_pages_by_a_second_parser(spark, data):
    for r in spark.read.parquet(f"{data}/pages.parquet").collect():
        assert to_markdown(r.html) == second(r.html), r.page_id


def test_made_pages_by_a_second_parser():
    r = random.Random(8)
    words = ["plain", "a &amp; b", "&lt;tag&gt;", "&eacute;&#233;&#xe9;", "x|y", "&nbsp;", "1. no list", "caf&eacute", "&unknown;", "<b>bold</b>", "<i>it</i>", "<code>f(x)</code>", '<a href="/q?a=1&amp;b=\'2\'">link <i>in</i></a>', "<a>bare</a>", "<b> </b>", "<!-- <p>no</p> -->"]
    run = lambda: " ".join(r.choices(words, k=r.randrange(1, 6)))
    for _ in range(300):
        parts = []
        for _ in range(r.randrange(1, 7)):
            kind = r.randrange(6)
            if kind == 0:
                parts.append(f"<h{r.randrange(1, 7)}>{run()}</h0>".replace("</h0>", ""))
                n = parts[-1][2]
                parts[-1] += f"</h{n}>"
            elif kind == 1:
                parts.append(f"<ul>{''.join(f'<li>{run()}</li>' for _ in range(r.randrange(1, 4)))}</ul>")
            elif kind == 2:
                parts.append(f"<ol>\n{''.join(f'<li>{run()}</li>' for _ in range(r.randrange(1, 4)))}</ol>")
            elif kind == 3:
                parts.append("<table>" + "".join("<tr>" + "".join(f"<td>{run()}</td>" for _ in range(r.randrange(1, 4))) + "</tr>" for _ in range(r.randrange(1, 4))) + "</table>")
            else:
                parts.append(f"<p>{run()}<br>{run()}</p>" if kind == 4 else f"<div class='a>b'>{run()}</div><script>if (a<b) {{}}</script>")
        page = "<html><head><title>t</title></head><body>" + "\n".join(parts) + "</body></html>"
        assert to_markdown(page) == second(page), page


@pytest.mark.parametrize(
    ("page", "expected"),
    [
        ("<ul><li>a<ul><li>b<ol><li>c</ol><li>d</ul><li>e</ul>", "- a\n  - b\n    1. c\n  - d\n- e"), ("<pre>\n x  <b>y</b>\n  z\n</pre>", "```\n x  **y**\n  z\n```"), ("<blockquote><p>a</p><p>b<br>c</blockquote>", "> a\n>\n> b\n> c"),
        ("<table><tr><th>A<th colspan=2>B<tr><td>1<td><table><tr><td>in<td>ner</table><td>3</table>", "| A | B |  |\n| --- | --- | --- |\n| 1 | in ner | 3 |"), ("a<hr>b<img src=x.png alt='an x'>", "a\n\n---\n\nb![an x](x.png)"), ("", ""), ("</p></li></table>x", "x"),
        ("<b>a<p>b</b>c", "**a**\n\nbc"), ("a < b && c > d", "a < b && c > d"), ("<td>alone</td><li>item", "alone item"), ("<a href='x'", "<a href='x'"), ("<TABLE><TR><TD>x</TD></TR></TABLE>", "| x |\n| --- |"),
    ],
)
def test_markdown_of(page, expected):
    assert to_markdown(page) == expected


def test_plain_rows_are_as_their_tags():
    """A row of plain cells is read at once; a space in its tag has the same row read tag by tag."""
    cells = ["<td> a  b</td>", "<td>x | y", "<th>&lt;q&#62;</th>", "<td></td>", "<td>a\n&nbsp;b</td>\n ", "<td>c > d"]
    for k in range(len(cells)):
        rows = "".join(f"<tr>{''.join(cells[i:] + cells[:k])}</tr>\n" for i in range(len(cells)))
        for page in (f"<table>{rows}</table>", f"<table><caption>t{rows}", f"<pre><table>{rows}</table></pre>", rows, f"<table><tr><td><table>{rows}</table></table>", f"<table>{rows}</table>\0"):
            assert to_markdown(page) == to_markdown(page.replace("<tr>", "<tr >"))
    assert to_markdown("<table><tr><td>a<td>b | c</tr></table>") == "| a | b \\| c |\n| --- | --- |"


def test_odd_pages_take_no_time():
    import time

    began = time.time()
    to_markdown("<div>" * 30_000 + "x")
    to_markdown("<ul><li>" * 300 + "x")
    to_markdown("<p>word " * 50_000)
    to_markdown("<b>" * 3_000 + "x")
    to_markdown("&amp;" * 200_000)
    assert time.time() - began < 20
    assert html.unescape("&amp;") == "&"


# what is checked, names in an order

def test_unique_names_and_missing_keys(spark):
    rows = [("1", "n", [{"name": "a", "voice_id": "v", "backstory": "", "personality": None}]), ("2", "n", [{"name": "a", "voice_id": "v", "backstory": "b", "personality": "p"}]), ("3", "o", []), ("4", "p", None), ("5", "q", [{"name": "x"}] * 5), ("6", "r", [{"voice_id": "v"}]), ("7", None, [{}])]
    got = {r.id: r.reject_reason for r in validation.speaker_profiles(spark.createDataFrame(rows, "id string, name string, speakers array<map<string,string>>")).collect()}
    count = "Must have between 1 and 4 speakers"
    assert got == {"1": None, "2": "name is taken", "3": count, "4": count, "5": count, "6": "Speaker missing required field: name", "7": "name is required"}


def test_first_name_by_an_order(spark):
    new = spark.createDataFrame([("a.txt", 9, "late"), ("a.txt", 1, "early"), ("a.txt", 5, "middle")], "file_name string, at int, who string").repartition(3)
    taken = spark.createDataFrame([("b.txt",)], "file_name string")
    assert {r.who: r.free_name for r in writes.free_names(taken, new, "at").collect()} == {"early": "a.txt", "middle": "a (1).txt", "late": "a (2).txt"}


def test_commands_are_typed(spark):
    from quire.operators import commands

    with pytest.raises(ValueError, match="lacks chunk_text"):
        commands.call(commands.EMBED_CHUNK, spark.createDataFrame([(1, "s", 0)], "k int, source_id string, chunk_index int"), "k", embed=len)
    short = commands.Command("app", "short", "t STRING", "n INT NOT NULL, missing STRING", lambda rows: rows.select("k", F.length("t").alias("n")))
    with pytest.raises(ValueError, match="output of short lacks missing"):
        commands.call(short, spark.createDataFrame([(1, "x")], "k int, t string"), "k")
    fine = commands.Command("app", "size", "t STRING", "n BIGINT", lambda rows: rows.select("k", F.length("t").alias("n")))
    out = commands.call(fine, spark.createDataFrame([(1, "xx"), (2, None)], "k int, t string").withColumn("more", F.lit(1)), "k")
    assert out.schema["n"].dataType.simpleString() == "bigint" and sorted(map(tuple, out.collect())) == [(1, True, None, 2), (2, True, None, None)]
    assert [tuple(r) for r in commands.listing(spark, [fine, commands.EMBED_CHUNK]).orderBy("name").collect()] == [("quire", "embed_chunk", "struct<source_id:string,chunk_index:int,chunk_text:string>", "struct<source_id:string,chunk_index:int,embedding:array<double>>"), ("app", "size", "struct<t:string>", "struct<n:bigint>")]
    with pytest.raises(ValueError, match="two commands"):
        commands.listing(spark, [fine, fine])


def test_terms_of_a_text_are_counted_in_its_row(spark):
    """One row goes out for each text, whatever it holds; words of one stem count together."""
    from collections import Counter

    from quire.functions.stem import stem
    from quire.operators import postings
    from quire.operators.search import tokens

    texts = ["running runs run", "", "¿?", "versions Version licenceX2 x", "a " * 3000 + "b"] + [f"w{k} the w{k % 7}" for k in range(2000)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string").coalesce(2).select("id", tokens(F.col("text")).alias("t"))
    words = {r.id: r.t for r in df.collect()}
    for stemmed in (False, True):
        out = df.mapInArrow(postings._tallied(stemmed), "id int, words int, terms string, counts array<int>").collect()
        assert len(out) == len(texts)
        for r in out:
            assert r.words == len(words[r.id]) and dict(zip(r.terms.split(), r.counts, strict=True)) == Counter(map(stem, words[r.id]) if stemmed else words[r.id])
