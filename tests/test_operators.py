import pytest
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import chunks, context, models, relational, search, writes
from quire.sources import files
from quire.streaming import jobs


def value(spark, text, f, kind="string"):
    return spark.createDataFrame([(text,)], f"t {kind}").select(f(F.col("t")).alias("v")).first().v


def test_thinking(spark):
    both = lambda t: (value(spark, t, T.thinking), value(spark, t, T.without_thinking))
    assert both("<think> a </think>x\n\n\n\ny<think>b</think> ") == ("a\n\nb", "x\n\ny")
    assert both(" plain ") == ("", " plain ")
    assert both(None) == ("", "")
    long = "<think>a</think>" + "x" * 100_001
    assert both(long) == ("", long)


def test_cleaning(spark):
    assert value(spark, "Hi é—☃x", T.remove_non_ascii) == "Hi x"
    assert value(spark, " a b c\x00d (é)! ", T.remove_non_printable) == "a b\ncd é!"
    assert value(spark, "five words are standing here", T.token_count) == 6
    assert value(spark, None, T.token_count) == 0
    assert value(spark, "Yes", T.truthy) is True


def test_upper_case_of_each_character(spark, duck):
    """Letters whose capitals are several characters, alone and among others, as DuckDB's upper() has them."""
    odd = [c for c in map(chr, range(0x10000)) if len(c.upper()) > 1]
    texts = [*odd, "Erßie", "ßß aﬁx ŉ", "straße 😀ß", "plain é", "", None]
    got = [r.v for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1).select("i", T.upper_each(F.col("t")).alias("v")).orderBy("i").collect()]
    assert got == [duck.execute("SELECT upper(?::VARCHAR)", [t]).fetchone()[0] for t in texts] and got[len(odd)] == "ERẞIE"


@pytest.mark.parametrize(("a", "b", "sign"), [("1.0", "1.0.0", 0), ("1.2", "1.10", -1), ("v2.0", "1.9.9", 1), ("1.0a1", "1.0", -1), ("1.0rc1", "1.0b2", 1), ("1.0.post1", "1.0", 1), ("1.0.dev1", "1.0a1", -1), ("2!1.0", "3.0", 1), ("1.0+a", "1.0", 1), ("1.0+1", "1.0+a", 1), (".".join(["1"] * 20), ".".join(["1"] * 19 + ["2"]), -1)])
def test_versions(spark, a, b, sign):
    assert spark.createDataFrame([(a, b)], "a string, b string").select(T.compare_versions(F.col("a"), F.col("b"))).first()[0] == sign


def test_citations(spark):
    text = "[source:a] [[note:b]] **source:a** source:c"
    assert value(spark, text, T.numbered_citations).startswith("[1](#ref-source-a) [2](#ref-note-b) **[1](#ref-source-a)** [3](#ref-source-c)\n\nReferences:\n[1] - [source:a](#ref-source-a)\n")
    assert value(spark, text, T.linked_citations) == "[[source:a]](#ref-source-a) [[[note:b]]](#ref-note-b) [**source:a**](#ref-source-a) [source:c](#ref-source-c)"
    assert [(c.key, text[c.start : c.end]) for c in value(spark, text, T.citations)] == [(k, k) for k in ("source:a", "note:b", "source:a", "source:c")]
    assert value(spark, "none", T.numbered_citations) == "none" and value(spark, "none", T.citations) == []
    long = "source:" + "x" * 101
    assert value(spark, long, T.linked_citations) == long


def test_repository(spark):
    assert tuple(value(spark, "https://github.com/a/b/", T.repository_of)) == ("a", "b")
    assert value(spark, "https://example.com/a/b", T.repository_of) is None


def test_chunks():
    assert chunks.split_text("") == [] and chunks.split_text("short") == ["short"]
    text = "\n\n".join(" ".join(f"w{i}x{j}" for j in range(60)) for i in range(30))
    got = chunks.split_text(text, 100)
    assert all(chunks.word_tokens(c) <= 100 for c in got)
    assert {w for c in got for w in c.split()} == set(text.split())
    long = "x" * 50 + " " + "y " * 400
    # pieces are counted one by one and each count is cut to an integer, so short words add up to a third more
    assert all(chunks.word_tokens(c) <= 65 for c in chunks.split_text(long, 50))


def test_chunks_of_nulls(spark):
    df = spark.createDataFrame([("a", None), ("b", ""), ("c", "x y"), ("d", " ")], "id string, full_text string")
    assert [tuple(r) for r in chunks.chunked(df).collect()] == [("c", 0, "x y")]


def test_search_guards(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0]), (4, None), (5, [1.0, 1.0])], "id int, embedding array<double>")
    got = search.near(df, "embedding", [1.0, 0.0], 0.7).orderBy("id").collect()
    assert [r.id for r in got] == [1, 5]
    with pytest.raises(ValueError):
        search.query_terms(" - ")
    assert search.query_terms("fooBar BAZ9 foo") == ["foo", "bar", "baz", "9"]


def test_all_terms_must_match(spark):
    df = spark.createDataFrame([(1, "red fox"), (2, "red hen"), (3, None)], "id int, t string")
    assert [r.id for r in search.bm25(df, "t", "fox Red").collect()] == [1]


def test_paging_is_checked(spark):
    df = spark.range(7)
    assert [r.id for r in relational.page(df, ["id"], 2, 3).collect()] == [3, 4, 5]
    for number, limit in ((0, 3), (1, 0), (1, 501)):
        with pytest.raises(ValueError):
            relational.page(df, ["id"], number, limit)
    with pytest.raises(ValueError):
        relational.order_clause("id; DROP TABLE x", ("id",))
    assert relational.page_count(df.where("id > 9"), 5).first().pages == 1


def test_merge_keeps_what_a_patch_leaves_out(spark):
    table = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "id string, n int, t string")
    patch = spark.createDataFrame([("a", None, "z"), ("c", 3, None)], "id string, n int, t string")
    assert sorted(tuple(r) for r in writes.merged(table, patch).collect()) == [("a", 1, "z"), ("b", 2, "y")]
    assert sorted(tuple(r) for r in writes.merged(table, patch, insert=True).select("id", "n").collect()) == [("a", 1), ("b", 2), ("c", 3)]
    assert writes.insert_batch(table, patch).count() == 2
    assert writes.insert_batch(table, patch.where("id = 'c'")).count() == 3


def names(spark, taken, new):
    given = writes.free_names(spark.createDataFrame([(x,) for x in taken], "file_name string"), spark.createDataFrame([(x,) for x in new], "file_name string"))
    return sorted((r.file_name, r.free_name) for r in given.collect())


def test_free_names(spark):
    assert names(spark, ["a.txt", "a (1).txt"], ["a.txt", "b.txt", "b.txt"]) == [("a.txt", "a (2).txt"), ("b.txt", "b (1).txt"), ("b.txt", "b.txt")]
    # the whole name counts, numbers and all; and the first number that is free is taken
    assert names(spark, ["a (1).txt"], ["a (1).txt"]) == [("a (1).txt", "a (1) (1).txt")]
    assert names(spark, ["c.txt", "c (2).txt", "c (4).txt"], ["c.txt"] * 3) == [("c.txt", "c (1).txt"), ("c.txt", "c (3).txt"), ("c.txt", "c (5).txt")]
    # names that are given in the same batch are taken too
    assert names(spark, ["d.txt"], ["d.txt", "d (1).txt"]) == [("d (1).txt", "d (1).txt"), ("d.txt", "d (2).txt")]
    assert names(spark, [".env", "x.tar.gz", "noext", "e. (1)"], [".env", "x.tar.gz", "noext", "e."]) == [(".env", ".env (1)"), ("e.", "e."), ("noext", "noext (1)"), ("x.tar.gz", "x.tar (1).gz")]
    assert names(spark, ["g (01).md", "g.md", "g (1)"], ["g.md"]) == [("g.md", "g (1).md")]


def test_free_names_by_brute_force(spark):
    """Never a taken name, never one twice, and each numbered name has the smallest numbers that are free."""
    import random

    r = random.Random(4)
    pool = [f"{stem}{n}{ext}" for stem in ("a", "b c", ".h", "a (1)") for n in ("", " (1)", " (2)", " (3)", " (02)") for ext in ("", ".x", ".y.x")]
    for _ in range(4):
        taken, new = r.sample(pool, 25), r.choices(pool, k=30)
        got = names(spark, taken, new)
        assert sorted(n for n, _ in got) == sorted(new) and len({f for _, f in got}) == len(got) and not {f for _, f in got} & set(taken)
        kept = {f for n, f in got if n == f}
        assert kept == set(new) - set(taken)
        for name in set(new):
            dot = name.rfind(".")
            stem, ext = (name[:dot], name[dot:]) if 0 < dot < len(name) - 1 else (name, "")
            free = (f for k in range(1, 99) if (f := f"{stem} ({k}){ext}") not in {*taken, *kept})
            numbered = [f for n, f in got if n == name and f != n]
            assert sorted(numbered) == sorted(next(free) for _ in numbered)


def test_export_headers(spark, tmp_path):
    rows = [("r1", "source:1", "B", None, "p, q", "m", None, "Detected", 0), ("r2", "source:1", "A", "R", "p", "m", "High", "x", 3)]
    df = spark.createDataFrame(rows, "id string, source_id string, building_id string, room_id string, product string, material_description string, risk_status string, result string, page_number int")
    files.write_csv(files.export_rows(df, "source:1").coalesce(1), str(tmp_path / "csv"))
    text = next((tmp_path / "csv").glob("*.csv")).read_text()
    assert text == "Building ID,Building Name,Room ID,Room Name,Product,Material Description,Extent,Location,Friable,Material Condition,Risk Status,Result,Page Number\nA,,R,,p,m,,,,,High,x,3\nB,,,,\"p, q\",m,,,,,,Detected,\n"


def test_context_budget(spark):
    items = spark.createDataFrame([("s1", "source", 100, 5, 0), ("n1", "note", 50, 4, 1), ("s1", "source", 100, 9, 2), ("s2", "source", 100, 6, 3)], "id string, type string, priority int, tokens long, position int")
    assert sorted(r.id for r in context.assemble(items, 11).collect()) == ["s1", "s2"]
    assert context.assemble(items).count() == 3
    assert [context.level_of(s) for s in ("not in", "insights", "full content", "insights full content", "")] == ["skip", "short", "full", "short", "skip"]


def test_running_totals_over_partitions(spark):
    import random

    r = random.Random(1)
    rows = [(g, k, r.randrange(5)) for g in ("hot", "small", None) for k in range(300 if g == "hot" else 7)]
    df = spark.createDataFrame(rows, "g string, k int, n long").repartition(8)
    out = {(x.g, x.k): x.upto for x in context.running_total(df, ["g"], [F.col("k").desc()], "n", "upto").collect()}
    assert out == {(g, k): sum(n for h, j, n in rows if h == g and j >= k) for g, k, _ in rows}
    alone = {x.k: x.upto for x in context.running_total(df.where("g = 'hot'"), [], [F.col("k")], "n", "upto").collect()}
    assert alone == {k: sum(n for h, j, n in rows if h == "hot" and j <= k) for k in range(300)}


def test_a_failing_call_is_asked_again(spark, tmp_path):
    marker = str(tmp_path / "asked")

    def answer(asked):
        import os

        n = len(os.listdir(os.path.dirname(marker)))
        open(f"{marker}{n}", "w").close()
        if n < 2:
            raise ConnectionError("not yet")
        return [t.upper() for _, t in asked]

    df = spark.createDataFrame([("a", "xy")], "id string, full_text string")
    assert [r.content for r in models.transformed(df, [("T", "p")], answer, wait=(0.01, 0.02)).collect()] == ["XY"]


def test_values_are_checked(spark):
    assert value(spark, "ai", lambda c: T.among(c, ("ai", "human"))) == "ai" and value(spark, None, lambda c: T.among(c, ("ai",))) is None
    with pytest.raises(Exception, match="invalid note type: robot"):
        value(spark, "robot", lambda c: T.among(c, ("ai", "human"), "note type"))
    assert value(spark, '["a", "b"]', T.json_array) == ["a", "b"] and value(spark, "", T.json_array) is None
    with pytest.raises(Exception, match=r"(?i)json|malformed"):
        value(spark, "[broken", T.json_array)
    with pytest.raises(ValueError, match="no value for x"):
        T.rendered("{{x}}")
    with pytest.raises(ValueError, match="no table"):
        relational.record({}, "source:1")


def test_stream_of_messages(spark, tmp_path):
    rows = [("t1", k, "user", f"m{k}") for k in range(5)] + [("t2", 0, "user", "x")]
    for part, batch in (("a", rows[:3]), ("b", rows[3:])):
        spark.createDataFrame(batch, "thread string, at long, role string, text string").coalesce(1).write.parquet(str(tmp_path / "in" / part))
        stream = spark.readStream.schema("thread string, at long, role string, text string").parquet(str(tmp_path / "in" / "*"))
        jobs.follow_threads(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(90)
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("t1", k + 1, "user", f"m{k}") for k in range(5)] + [("t2", 1, "user", "x")]


def test_many_searches_in_a_batch(spark):
    df = spark.createDataFrame([(k, [float(k == j) for j in range(7)]) for k in range(7)], "id int, embedding array<double>")
    found = search.batch_search([(f"q{k}", [float(k == j) for j in range(7)]) for k in range(7)], df, k=1).collect()
    assert sorted((r.query, r.id) for r in found) == [(f"q{k}", k) for k in range(7)]


def test_chunks_by_brute_force(spark):
    """Chunks of random texts hold every word in order, stay within the size, and overlap by whole pieces."""
    import random

    r = random.Random(2)
    for _ in range(60):
        text = "".join(f"w{k}" + r.choice([" ", ".", ", ", "\n", "\n\n", " and then. "]) for k in range(r.randrange(1, 300)))
        size = r.choice([10, 40, 90])
        got = chunks.split_text(text, size)
        assert not got or max(map(chunks.word_tokens, got)) <= 1.5 * size
        spans = [(text.index(c), text.index(c) + len(c)) for c in got]  # words are numbered, so a chunk has one place
        assert spans == sorted(spans)
        covered = {k for lo, hi in spans for k in range(lo, hi)}
        assert all(k in covered for k, ch in enumerate(text) if not ch.isspace())
        shared = [max(0, z - a) for (_, z), (a, _) in zip(spans, spans[1:])]
        assert all(chunks.word_tokens(text[a : a + n]) <= 1.3 * 0.15 * size + 2 for (a, _), n in zip(spans[1:], shared, strict=True))
    rows = [(i, "para one. " * n) for i, n in enumerate((0, 1, 3, 500, 2000))]
    out = chunks.chunked(spark.createDataFrame(rows, "id int, full_text string"), size=50).collect()
    assert {(x.id, x.order): x.content for x in out} == {(i, k): c for i, t in rows for k, c in enumerate(chunks.split_text(t, 50))}


def test_models(spark):
    df = spark.createDataFrame([("a", "xy"), ("b", None)], "id string, content string")
    got = {r.id: r.embedding for r in models.embedded(df, lambda texts: [[float(len(t))] for t in texts]).collect()}
    assert got == {"a": [2.0], "b": []}


def test_a_call_gets_a_megabyte_of_text(spark):
    """However many rows a batch has; a text that is longer goes alone."""
    from quire.operators import ask, commands

    sizes = [300_000] * 10 + [3_000_000, 1, 0]
    df = spark.createDataFrame([(i, "x" * n) for i, n in enumerate(sizes)] + [(13, None)], "id int, content string").coalesce(1)
    told = lambda texts: [[float(sum(map(len, texts)))] for _ in texts]
    refused = lambda texts: told(texts) if len(texts) == 1 else [][1]

    def right(got):
        assert set(got) == set(range(13)) and all(sizes[i] <= n <= max(1 << 20, sizes[i]) for i, n in got.items())

    right({r.id: r.embedding[0] for r in models.embedded(df, told).collect() if r.embedding})
    right({r.id: r.embedding[0] for r in models.attempted(df, told).collect() if r.embedding})
    assert {r.id: (r.embedding, r.error) for r in models.attempted(df, refused).collect()} == {13: ([], None)} | {i: ([float(n)], None) for i, n in enumerate(sizes)}
    each = models.transformed(df, [("A", "a"), ("B", "b")], lambda asked: [str(sum(len(t) for _, t in asked)) for _ in asked], "id", "content").collect()
    for kind in "AB":
        right({r.source: int(r.content) for r in each if r.insight_type == kind})
    said = ask._asked(df.where("id < 13").withColumnRenamed("content", "payload"), lambda texts: [str(sum(map(len, texts))) for _ in texts], ["id"])
    right({r.id: int(r.said) for r in said.collect()})
    rows = df.selectExpr("id", "'s' AS source_id", "id AS chunk_index", "content AS chunk_text")
    made = {r.id: r for r in commands.call(commands.EMBED_CHUNK, rows, "id", embed=told).collect()}
    assert made[13].error == "chunk_text is required" and len(made) == 14
    right({i: r.embedding[0] for i, r in made.items() if r.success})


def test_event_frames(spark):
    df = spark.createDataFrame([("strategy", "x"), ("complete", None)], "type string, content string")
    frames = files.event_frames(df).unionByName(spark.createDataFrame([("data: {broken\n\nnoise",)], "frame string"))
    assert sorted(r.type for r in files.parsed_frames(frames, "type string, content string").collect()) == ["complete", "strategy"]


def test_pages(spark):
    html = "<html><head><title>T</title><style>p{}</style></head><body><p>a &amp; b</p><script>x()</script><p>c</p></body></html>"
    assert value(spark, html, files.page_text) == "a & b\nc"


def test_stream_of_jobs(spark, tmp_path):
    log = spark.createDataFrame([("j1", 1, "2024-01-01 00:00:00", "new"), ("j1", 2, "2024-01-01 00:00:05", "completed"), ("j2", 3, "2024-01-01 00:00:01", "running")], "job_id string, event_id long, ts string, status string").withColumn("ts", F.col("ts").cast("timestamp"))
    log.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(log.schema).parquet(str(tmp_path / "in"))
    jobs.follow(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(60)
    got = {r.job_id: r.status for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"j1": "completed", "j2": "running"}
    assert {r.job_id for r in jobs.cancelled(log, log, "2024-01-02").where("status = 'cancelled'").collect()} == {"j2"}


STEMS = {"consigned": "consign", "consolatory": "consolatori", "knackeries": "knackeri", "generate": "generat", "communism": "communism", "hopping": "hop", "hoping": "hope", "skies": "sky", "cries": "cri", "ties": "tie", "gas": "gas", "feed": "feed", "vileness": "vile", "easily": "easili", "by": "by"}


def test_stems():
    from quire.functions.stem import stem

    assert {w: stem(w) for w in STEMS} == STEMS


def test_what_words_of_a_stem_begin_with():
    """Words of every suffix of the rules, alone and two in a row, begin as their stems say."""
    import random

    from quire.functions import stem as S

    r = random.Random(3)
    ends = ["", "s", "es", "ies", "ied", "sses", "us", "eed", "eedly", "ed", "edly", "ing", "ingly", "y", "e", "ll", "ility", "ogy", *S.STEP_2, *S.STEP_3, *S.STEP_4, *(e.replace("i", "y") for e in S.STEP_2)]
    words = [*S.IRREGULAR, *S.KEPT]
    for _ in range(60_000):
        words.append("".join(r.choice("bcdglmnrstvy") * r.randint(0, 2) + r.choice("aeiouy") for _ in range(r.randint(0, 3))) + r.choice(ends) + r.choice(ends))
    for w in filter(None, words):
        assert w.startswith(search.begins(S.stem(w))), w


def test_texts_without_a_form_are_read_once(spark):
    """Only texts with a word that begins like a stem are parted; results are those of plain parting."""
    docs = spark.createDataFrame([(0, "A Licensed text, of VERSIONS"), (1, "nothing here"), (2, None), (3, ""), (4, "xlicense subversion"), (5, "licence licens")], "id int, t string")
    out = {x.id: x.highlight for x in search.highlight(docs, "t", "Licensing versions").collect()}
    assert out == {0: "A `Licensed` text, of `VERSIONS`", 1: "nothing here", 2: None, 3: "", 4: "xlicense subversion", 5: "licence licens"}
    assert [sorted(c) for c in search.word_forms(docs, ["t"], ["licens", "version"]).first()] == [["licensed"], ["versions"]]


def test_stemmed_search_counts_every_form(spark):
    from quire.operators.search import bm25

    texts = {1: "Hopes hoped hoping for a library", 2: "hop in libraries", 3: "hope", 4: None, 5: "", 6: "HOPE library library"}
    docs = spark.createDataFrame(list(texts.items()), "id int, t string")
    plain = spark.createDataFrame([(1, "hope hope hope for a library"), (2, "hop in library"), (3, "hope"), (4, None), (5, ""), (6, "hope library library")], "id int, t string")
    score = lambda df, stemmed: {r.id: round(r.relevance, 9) for r in bm25(df, "t", "hoping Libraries" if stemmed else "hope library", stemmed).collect()}
    assert score(docs, True) == score(plain, False)
    assert set(score(docs, True)) == {1, 6}
    assert bm25(docs.limit(0), "t", "hope", True).count() == 0
    assert bm25(docs, "t", "absent", True).count() == 0
