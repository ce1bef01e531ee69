"""Every operator as a query over the parquet tables, with SQL that gives the same rows where SQL can."""

from __future__ import annotations

import hashlib
import json
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import ask, chunks, context, models, postings, ranges, register, relational, search, vectors, writes
from ..operators.durable import shared_folder
from ..sources import files
from ..streaming import jobs
from . import sqlfunctions
from .registry import ORACLES, QUERIES, query  # noqa: F401
from .views import Tables, sql

#: Query vector: that of vec_id 0, read from the table. Query text: two frequent words of the texts.
TEXT = "the of"


def _vector(t: Tables, vec_id: int) -> list[float]:
    """One row's vector."""
    row = t.raw("embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()
    return [float(x) for x in row.embedding]


# search

_Q = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)"
_NEAR = """SELECT *, list_cosine_similarity(embedding, (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) AS similarity FROM {0} WHERE embedding IS NOT NULL AND len(embedding) = len((SELECT embedding FROM embeddings WHERE vec_id = 0))"""


@query(sql("source_embedding", f"SELECT id, source, content, round(similarity, 6) AS similarity FROM ({_NEAR.format('v_source_embedding')}) WHERE similarity >= 0.2 ORDER BY similarity DESC, id LIMIT 10"))
def vector_search(t: Tables) -> DataFrame:
    x = search.near(t.source_embedding(), "embedding", _vector(t, 0), 0.2)
    return x.orderBy(F.col("similarity").desc(), "id").limit(10).select("id", "source", "content", F.round("similarity", 6).alias("similarity"))


@query(sql("source source_embedding source_insight note", f"""
  , a AS (SELECT source AS id, source AS parent_id, content, similarity FROM ({_NEAR.format('v_source_embedding')}) z WHERE similarity >= 0.1 ORDER BY similarity DESC, z.id LIMIT 20),
  b AS (SELECT id, source AS parent_id, insight_type, content, similarity FROM ({_NEAR.format('v_source_insight')}) WHERE similarity >= 0.1 ORDER BY similarity DESC, id LIMIT 20),
  c AS (SELECT id, id AS parent_id, title, content, similarity FROM ({_NEAR.format('v_note')}) WHERE similarity >= 0.1 ORDER BY similarity DESC, id LIMIT 20),
  u AS (SELECT a.id, parent_id, s.title, content, similarity FROM a LEFT JOIN v_source s ON s.id = a.parent_id
    UNION SELECT b.id, parent_id, insight_type || ' - ' || coalesce(s.title, ''), content, similarity FROM b LEFT JOIN v_source s ON s.id = b.parent_id UNION SELECT * FROM c)
  SELECT id, parent_id, title, round(max(similarity), 6) AS similarity, string_agg(content, '|' ORDER BY similarity DESC, content) AS matches FROM u GROUP BY id, parent_id, title ORDER BY max(similarity) DESC, id LIMIT 20"""))
def vector_search_grouped(t: Tables) -> DataFrame:
    x = search.vector_search(_vector(t, 0), 20, t.source(), t.source_embedding(), t.source_insight(), t.note(), least=0.1)
    return x.select("id", "parent_id", "title", F.round("similarity", 6).alias("similarity"), F.array_join("matches", "|").alias("matches"))


_TOKENS = r"regexp_extract_all(lower(regexp_replace(regexp_replace(regexp_replace({0}, '(\p{{Ll}})(\p{{Lu}})', '\1 \2', 'g'), '(\p{{L}})(\p{{N}})', '\1 \2', 'g'), '(\p{{N}})(\p{{L}})', '\1 \2', 'g')), '[\p{{L}}\p{{N}}]+')"


def _bm25(n: str, table: str, text: str) -> str:
    """CTEs: n holds the rows of table with relevance, for the terms 'the' and 'of'."""
    return f"""{n}_t AS (SELECT *, {_TOKENS.format(text)} AS tok FROM {table} WHERE {text} IS NOT NULL),
  {n}_f AS (SELECT * EXCLUDE tok, len(tok) AS dl, len(list_filter(tok, lambda x: x = 'the')) AS tf0, len(list_filter(tok, lambda x: x = 'of')) AS tf1 FROM {n}_t),
  {n}_s AS (SELECT count(*) AS cnt, avg(dl) AS avgdl, count(*) FILTER (tf0 > 0) AS df0, count(*) FILTER (tf1 > 0) AS df1 FROM {n}_f),
  {n} AS (SELECT f.*, ln(1 + (cnt - df0 + 0.5::DOUBLE) / (df0 + 0.5::DOUBLE)) * tf0 * 2.2::DOUBLE / (tf0 + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))
    + ln(1 + (cnt - df1 + 0.5::DOUBLE) / (df1 + 0.5::DOUBLE)) * tf1 * 2.2::DOUBLE / (tf1 + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)) AS relevance FROM {n}_f f, {n}_s WHERE tf0 > 0 AND tf1 > 0)"""


@query(sql("source", f", x AS (SELECT id, full_text FROM v_source), {_bm25('r', 'x', 'full_text')} SELECT id, round(relevance, 6) AS relevance FROM r"))
def text_search_bm25_nostem(t: Tables) -> DataFrame:
    return search.bm25(t.source().select("id", "full_text"), "full_text", TEXT).select("id", F.round("relevance", 6).alias("relevance"))


@query(sql("source source_embedding source_insight note", f""", {_bm25('a', 'v_source', 'title')}, {_bm25('b', 'v_source_embedding', 'content')}, {_bm25('c', 'v_source', 'full_text')}, {_bm25('d', 'v_source_insight', 'content')}, {_bm25('e', 'v_note', 'title')}, {_bm25('g', 'v_note', 'content')},
  u AS (SELECT id, id AS parent_id, title, max(relevance) AS relevance FROM a GROUP BY ALL UNION SELECT b.source, b.source, s.title, max(relevance) FROM b LEFT JOIN v_source s ON s.id = b.source GROUP BY ALL
    UNION SELECT id, id, title, max(relevance) FROM c GROUP BY ALL UNION SELECT d.id, d.id, insight_type || ' - ' || coalesce(s.title, ''), max(relevance) FROM d LEFT JOIN v_source s ON s.id = d.source GROUP BY ALL
    UNION SELECT id, id, title, max(relevance) FROM e GROUP BY ALL UNION SELECT id, id, title, max(relevance) FROM g GROUP BY ALL)
  SELECT id, parent_id, title, round(max(relevance), 6) AS relevance FROM u WHERE id IS NOT NULL GROUP BY id, parent_id, title ORDER BY max(relevance) DESC, id LIMIT 25"""))
def text_search_union(t: Tables) -> DataFrame:
    return search.text_search(TEXT, 25, t.source(), t.source_embedding(), t.source_insight(), t.note(), stemmed=False).withColumn("relevance", F.round("relevance", 6))


#: Forms of two stems: what the stemmed query stands for, as plain words.
_FORMS = {"'the'": "['license', 'licensed', 'licenses', 'licensing', 'licens']", "'of'": "['version', 'versions', 'versioned', 'versioning']"}


def _stemmed(text: str) -> str:
    for word, forms in _FORMS.items():
        text = text.replace(f"x = {word}", f"list_contains({forms}, x)")
    return text


@query(sql("source", _stemmed(f", x AS (SELECT id, full_text FROM v_source), {_bm25('r', 'x', 'full_text')} SELECT id, round(relevance, 6) AS relevance FROM r")))
def text_search_stemmed(t: Tables) -> DataFrame:
    return search.bm25(t.source().select("id", "full_text"), "full_text", "Licensing versions", stemmed=True).select("id", F.round("relevance", 6).alias("relevance"))


_BRANCHES = f""", {_bm25('a', 'v_source', 'title')}, {_bm25('b', 'v_source_embedding', 'content')}, {_bm25('c', 'v_source', 'full_text')}, {_bm25('d', 'v_source_insight', 'content')}, {_bm25('e', 'v_note', 'title')}, {_bm25('g', 'v_note', 'content')},
  u AS (SELECT 'source title' AS branch, id AS i, max(relevance) AS r FROM a GROUP BY id, title UNION ALL SELECT 'chunk', source, max(relevance) FROM b GROUP BY source UNION ALL SELECT 'source text', id, max(relevance) FROM c GROUP BY id, title
    UNION ALL SELECT 'insight', id, max(relevance) FROM d GROUP BY id, source, insight_type UNION ALL SELECT 'note title', id, max(relevance) FROM e GROUP BY id, title UNION ALL SELECT 'note text', id, max(relevance) FROM g GROUP BY id, title)
  SELECT branch, count(*) AS found, round(max(r), 6) AS best, round(sum(r), 4) AS total FROM u GROUP BY branch"""


@query(sql("source source_embedding source_insight note", _BRANCHES))
def text_search_branches(t: Tables) -> DataFrame:
    found = search.text_branches(TEXT, t.source(), t.source_embedding(), t.source_insight(), t.note(), stemmed=False)
    parts = [df.agg(F.count("*").alias("found"), F.round(F.max("relevance"), 6).alias("best"), F.round(F.sum("relevance"), 4).alias("total")).select(F.lit(name).alias("branch"), "found", "best", "total") for name, df in found.items()]
    return reduce(DataFrame.unionByName, parts)


_UNION = _BRANCHES[: _BRANCHES.index("  u AS")] + """
  u AS (SELECT id, id AS parent_id, title, max(relevance) AS relevance FROM a GROUP BY ALL UNION SELECT b.source, b.source, s.title, max(relevance) FROM b LEFT JOIN v_source s ON s.id = b.source GROUP BY ALL
    UNION SELECT id, id, title, max(relevance) FROM c GROUP BY ALL UNION SELECT d.id, d.id, insight_type || ' - ' || coalesce(s.title, ''), max(relevance) FROM d LEFT JOIN v_source s ON s.id = d.source GROUP BY ALL
    UNION SELECT id, id, title, max(relevance) FROM e GROUP BY ALL UNION SELECT id, id, title, max(relevance) FROM g GROUP BY ALL)
  SELECT id, parent_id, title, round(max(relevance), 6) AS relevance FROM u WHERE id IS NOT NULL GROUP BY id, parent_id, title ORDER BY max(relevance) DESC, id LIMIT 25"""


@query(sql("source source_embedding source_insight note", _stemmed(_UNION)))
def text_search_stored(t: Tables) -> DataFrame:
    """From postings that are written first: the search reads no text."""
    folder = shared_folder(t.spark, "postings")
    postings.add(postings.search_rows(t.source(), t.source_embedding(), t.source_insight(), t.note()), folder, t.spark)
    return postings.search(t.spark, folder, "Licensing versions", 25).withColumn("relevance", F.round("relevance", 6))


@query(sql("source source_embedding source_insight note", _UNION.replace("FROM v_note)", "FROM v_note WHERE note_type = 'ai')")))
def text_search_changed(t: Tables) -> DataFrame:
    """From postings of three segments: sources that had other texts first are replaced, notes by people are removed."""
    folder = shared_folder(t.spark, "postings")
    rows = postings.search_rows(t.source(), t.source_embedding(), t.source_insight(), t.note())
    old = rows.withColumn("text", F.when(F.col("field").startswith("source") & F.crc32("id").bitwiseAND(1).cast("boolean"), F.concat(F.lit("the the of "), "title")).otherwise(F.col("text")))
    postings.add(old, folder, t.spark, stemmed=False)
    postings.add(rows.where(F.col("field").startswith("source") & F.crc32("id").bitwiseAND(1).cast("boolean")), folder, t.spark)
    gone = t.note().where("note_type = 'human'").select(F.explode(F.array(F.lit("note title"), F.lit("note text"))).alias("field"), "id")
    postings.add(None, folder, t.spark, removed=gone)
    return postings.search(t.spark, folder, TEXT, 25).withColumn("relevance", F.round("relevance", 6))


@query(sql("source source_embedding source_insight note", _stemmed(_UNION)))
def text_search_in_sql(t: Tables) -> DataFrame:
    """The search as a table function of SQL, beside other tables."""
    folder = shared_folder(t.spark, "postings")
    postings.add(postings.search_rows(t.source(), t.source_embedding(), t.source_insight(), t.note()), folder, t.spark)
    sqlfunctions.register_text_search(t.spark, folder)
    return t.spark.sql("SELECT id, parent_id, title, round(relevance, 6) AS relevance FROM text_search('Licensing versions', 25)")


_PARTED = r"regexp_replace(regexp_replace(regexp_replace(text, '(\p{Ll})(\p{Lu})', '\1' || chr(1) || '\2', 'g'), '(\p{L})(\p{N})', '\1' || chr(1) || '\2', 'g'), '(\p{N})(\p{L})', '\1' || chr(1) || '\2', 'g')"


@query(f"""WITH p AS (SELECT doc_id, regexp_extract_all({_PARTED}, '[\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+') AS parts FROM documents WHERE text IS NOT NULL)
  SELECT doc_id, sha256(replace(array_to_string([CASE WHEN list_contains({_FORMS["'the'"]}, lower(p)) OR list_contains({_FORMS["'of'"]}, lower(p)) THEN '`' || p || '`' ELSE p END FOR p IN parts], ''), chr(1), '')) AS marked FROM p""")
def text_highlight(t: Tables) -> DataFrame:
    x = search.highlight(t.raw("documents").where(F.col("text").isNotNull()), "text", "Licensing versions")
    return x.select("doc_id", F.sha2(F.col("highlight").cast("binary"), 256).alias("marked"))


@query(sql("source_embedding", """, q AS (SELECT 'label ' || vec_id AS query, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id < 3),
  s AS (SELECT query, id, list_cosine_similarity(embedding, v) AS similarity FROM v_source_embedding, q),
  r AS (SELECT query, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, id) AS rank, id, similarity FROM s WHERE similarity >= 0.2)
  SELECT query, rank, id, round(similarity, 6) AS similarity FROM r WHERE rank <= 10"""))
def ask_retrieval_batch(t: Tables) -> DataFrame:
    x = search.batch_search([(f"label {i}", _vector(t, i)) for i in range(3)], t.source_embedding())
    return x.select("query", F.col("rank").cast("long").alias("rank"), "id", F.round("similarity", 6).alias("similarity"))


@query(sql("source_embedding", f"SELECT id, source, content, round(similarity, 6) AS similarity FROM ({_NEAR.format('v_source_embedding')}) WHERE similarity >= 0.2 ORDER BY similarity DESC, id LIMIT 10"))
def vector_search_stored(t: Tables) -> DataFrame:
    """From vectors that are written by cells first: the search opens the blocks that can hold one of the ten best."""
    folder, q = shared_folder(t.spark, "vectors"), _vector(t, 0)
    vectors.write(t.source_embedding().select("id", "source", "content", "embedding"), folder, len(q))
    x = vectors.nearest(t.spark, folder, q, 10, least=0.2)
    return x.select("id", "source", "content", F.round("similarity", 6).alias("similarity"))


@query(sql("source source_embedding source_insight note", f"""
  , a AS (SELECT source AS id, source AS parent_id, content, similarity FROM ({_NEAR.format('v_source_embedding')}) z WHERE similarity >= 0.3 ORDER BY similarity DESC, z.id LIMIT 15),
  b AS (SELECT id, source AS parent_id, insight_type, content, similarity FROM ({_NEAR.format('v_source_insight')}) WHERE similarity >= 0.3 ORDER BY similarity DESC, id LIMIT 15),
  c AS (SELECT id, id AS parent_id, title, content, similarity FROM ({_NEAR.format('v_note')}) WHERE similarity >= 0.3 ORDER BY similarity DESC, id LIMIT 15),
  u AS (SELECT a.id, parent_id, s.title, content, similarity FROM a LEFT JOIN v_source s ON s.id = a.parent_id
    UNION SELECT b.id, parent_id, insight_type || ' - ' || coalesce(s.title, ''), content, similarity FROM b LEFT JOIN v_source s ON s.id = b.parent_id UNION SELECT * FROM c)
  SELECT id, parent_id, title, round(max(similarity), 6) AS similarity, string_agg(content, '|' ORDER BY similarity DESC, content) AS matches FROM u GROUP BY id, parent_id, title ORDER BY max(similarity) DESC, id LIMIT 15"""))
def vector_search_in_sql(t: Tables) -> DataFrame:
    sqlfunctions.register_vector_search(t.spark, t.source(), t.source_embedding(), t.source_insight(), t.note())
    q = ", ".join(f"{x!r}D" for x in _vector(t, 0))
    return t.spark.sql(f"SELECT id, parent_id, title, round(similarity, 6) AS similarity, array_join(matches, '|') AS matches FROM vector_search(array({q}), 15, 0.3D)")


_ASKED = """, vectors AS (SELECT 'topic ' || vec_id AS term, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id < 4),
  asked AS (SELECT DISTINCT conv_id AS question_id FROM conversations),
  strategy AS (SELECT question_id, n, CASE WHEN n = 2 THEN 'nothing' ELSE 'topic ' || ((question_id + n) % 4) END AS term FROM asked, (SELECT unnest([0, 1, 2]) AS n) WHERE question_id % 5 <> 4),
  a AS (SELECT term, z.source AS id, z.source AS parent_id, z.content, list_cosine_similarity(z.embedding, v) AS similarity FROM v_source_embedding z, vectors WHERE list_cosine_similarity(z.embedding, v) >= 0.2 QUALIFY row_number() OVER (PARTITION BY term ORDER BY similarity DESC, z.id) <= 10),
  b AS (SELECT term, z.id, z.source AS parent_id, z.insight_type, z.content, list_cosine_similarity(z.embedding, v) AS similarity FROM v_source_insight z, vectors WHERE list_cosine_similarity(z.embedding, v) >= 0.2 QUALIFY row_number() OVER (PARTITION BY term ORDER BY similarity DESC, z.id) <= 10),
  c AS (SELECT term, z.id, z.id AS parent_id, z.title, z.content, list_cosine_similarity(z.embedding, v) AS similarity FROM v_note z, vectors WHERE list_cosine_similarity(z.embedding, v) >= 0.2 QUALIFY row_number() OVER (PARTITION BY term ORDER BY similarity DESC, z.id) <= 10),
  u AS (SELECT term, a.id, parent_id, s.title, similarity FROM a LEFT JOIN v_source s ON s.id = a.parent_id UNION SELECT term, b.id, parent_id, insight_type || ' - ' || coalesce(s.title, ''), similarity FROM b LEFT JOIN v_source s ON s.id = b.parent_id UNION SELECT term, id, parent_id, title, similarity FROM c),
  g AS (SELECT term, id, max(similarity) AS similarity FROM u GROUP BY term, id, parent_id, title QUALIFY row_number() OVER (PARTITION BY term ORDER BY max(similarity) DESC, id) <= 10),
  found AS (SELECT term, string_agg(id, ',' ORDER BY similarity DESC, id) AS ids FROM g GROUP BY term),
  answered AS (SELECT question_id, n, sha256('question ' || question_id || '|' || term || '|' || ids) AS answer FROM strategy JOIN found USING (term)),
  gathered AS (SELECT q.question_id, count(answer) AS answers, coalesce(string_agg(answer, '|' ORDER BY n), '') AS all_answers FROM asked q LEFT JOIN answered USING (question_id) GROUP BY q.question_id)
  SELECT question_id, (SELECT count(*) FROM strategy s WHERE s.question_id = g.question_id) AS searches, answers, sha256('question ' || question_id || '|' || all_answers) AS final_answer FROM gathered g"""


@query(sql("source source_embedding source_insight note", _ASKED))
def ask_graph(t: Tables) -> DataFrame:
    """A question for each conversation; the injected models digest what was retrieved."""
    known = {f"topic {i}": _vector(t, i) for i in range(4)}
    zero = [0.0] * len(known["topic 0"])

    def plan(questions: list[str]) -> list[str]:
        out = []
        for q in questions:
            i = int(q.split()[-1])
            searches = [] if i % 5 == 4 else [{"term": x, "instructions": f"say what {x} is"} for x in (f"topic {i % 4}", f"topic {(i + 1) % 4}", "nothing")]
            out.append("<think>where to look</think>" + json.dumps({"reasoning": "topics", "searches": searches}))
        return out

    def embed(terms: list[str]) -> list[list[float]]:
        return [known.get(x, zero) for x in terms]

    def digest(*parts: str) -> str:
        return "<think>so many</think>" + hashlib.sha256("|".join(parts).encode()).hexdigest()

    def answer(payloads: list[str]) -> list[str]:
        return [digest(p["question"], p["term"], ",".join(p["ids"])) for p in map(json.loads, payloads)]

    def conclude(payloads: list[str]) -> list[str]:
        return [digest(p["question"], "|".join(p["answers"])) for p in map(json.loads, payloads)]

    questions = t.raw("conversations").select(F.col("conv_id").alias("question_id")).distinct().withColumn("question", F.concat(F.lit("question "), "question_id"))
    x = ask.ask(questions, plan, embed, answer, conclude, t.source(), t.source_embedding(), t.source_insight(), t.note())
    return x.select("question_id", F.size("searches").cast("long").alias("searches"), F.size("answers").cast("long").alias("answers"), "final_answer")


# register tables: filters, paging, statistics

_REC = "id, source_id, building_id, room_id, risk_status, product"


@query(sql("acm_record", f"SELECT {_REC} FROM v_acm_record WHERE building_id = 'B1' ORDER BY building_id NULLS FIRST, room_id NULLS FIRST, id LIMIT 50 OFFSET 50"))
def acm_list_page(t: Tables) -> DataFrame:
    x = relational.equal(t.acm_record(), building_id="B1", risk_status="", room_id=None)
    return relational.page(x, ["building_id", "room_id", "id"], 2, 50).select(*_REC.split(", "))


@query(sql("acm_record", f"SELECT {_REC} FROM v_acm_record ORDER BY building_id NULLS FIRST, room_id NULLS FIRST, id LIMIT 50 OFFSET (SELECT 50 * (count(*) // 100) FROM v_acm_record)"))
def acm_list_page_deep(t: Tables) -> DataFrame:
    """The page in the middle of the whole table, read from the ranges that hold it."""
    pages = ranges.Pages.write(t.acm_record().select(*_REC.split(", ")), ["building_id", "room_id", "id"], shared_folder(t.spark, "pages"))
    return pages.page(pages.total // 100 + 1, 50)


@query(sql("acm_record", f"SELECT {_REC} FROM v_acm_record WHERE id > (SELECT min(id) FROM v_acm_record WHERE building_id = 'B5') AND building_id = 'B5' OR building_id > 'B5' ORDER BY building_id, id LIMIT 30"))
def acm_list_after(t: Tables) -> DataFrame:
    """The next rows behind the first of a building."""
    records = t.acm_record().select(*_REC.split(", "))
    first = records.where("building_id = 'B5'").agg(F.min("id").alias("id")).first()
    return ranges.after(records, [("building_id", "asc"), ("id", "asc")], {"building_id": "B5", "id": first.id}, 30)


@query(sql("acm_record", "SELECT count(*) AS total, greatest(ceil(count(*) / 50), 1)::BIGINT AS pages FROM v_acm_record WHERE risk_status = 'High'"))
def acm_count_pages(t: Tables) -> DataFrame:
    return relational.page_count(relational.equal(t.acm_record(), risk_status="High"), 50)


@query(sql("acm_record", f"SELECT {_REC} FROM v_acm_record WHERE source_id = 'source:1' ORDER BY building_id, room_id"))
def acm_by_source(t: Tables) -> DataFrame:
    return relational.equal(t.acm_record(), source_id="source:1").orderBy("building_id", "room_id").select(*_REC.split(", "))


@query(sql("acm_record", f"SELECT {_REC} FROM v_acm_record WHERE building_id = 'B2' ORDER BY room_id"))
def acm_by_building(t: Tables) -> DataFrame:
    return relational.equal(t.acm_record(), building_id="B2").orderBy("room_id").select(*_REC.split(", "))


@query(sql("acm_record", f"SELECT {_REC} FROM v_acm_record WHERE risk_status = 'Low'"))
def acm_by_risk(t: Tables) -> DataFrame:
    return relational.equal(t.acm_record(), risk_status="Low").select(*_REC.split(", "))


_SUMMARY = """SELECT count(*) AS total_records, count(*) FILTER (risk_status = 'High') AS high_risk_count, count(*) FILTER (risk_status = 'Medium') AS medium_risk_count, count(*) FILTER (risk_status = 'Low') AS low_risk_count,
  count(DISTINCT building_id) AS building_count, count(DISTINCT nullif(room_id, '')) AS room_count FROM v_acm_record"""


@query(sql("acm_record", _SUMMARY + " WHERE source_id = 'source:1'"))
def acm_summary_source(t: Tables) -> DataFrame:
    return relational.register_summary(relational.equal(t.acm_record(), source_id="source:1"))


@query(sql("acm_record", _SUMMARY))
def acm_summary_global(t: Tables) -> DataFrame:
    return relational.register_summary(t.acm_record())


@query(sql("acm_record", """SELECT building_id AS "Building ID", '' AS "Building Name", coalesce(room_id, '') AS "Room ID", '' AS "Room Name", product AS "Product", material_description AS "Material Description", '' AS "Extent", '' AS "Location", '' AS "Friable",
  '' AS "Material Condition", coalesce(risk_status, '') AS "Risk Status", result AS "Result", CASE WHEN coalesce(page_number, 0) = 0 THEN '' ELSE page_number::VARCHAR END AS "Page Number" FROM v_acm_record WHERE source_id = 'source:2' ORDER BY building_id, room_id, id"""))
def acm_export_rows(t: Tables) -> DataFrame:
    return files.export_rows(t.acm_record(), "source:2")


@query(sql("acm_record", """SELECT building_id, count(*) AS records, count(*) FILTER (risk_status = 'High') AS high FROM v_acm_record GROUP BY building_id"""))
def acm_by_building_counts(t: Tables) -> DataFrame:
    return t.acm_record().groupBy("building_id").agg(F.count("*").alias("records"), F.count_if(F.col("risk_status") == "High").alias("high"))


# links

@query(sql("notebook reference note", """SELECT n.id, name, description, archived, (SELECT count(*) FROM v_reference r WHERE r.out = n.id) AS source_count, (SELECT count(*) FROM v_note o WHERE o.notebook = n.id) AS note_count FROM v_notebook n"""))
def notebook_counts(t: Tables) -> DataFrame:
    return relational.with_count(relational.with_count(t.notebook(), t.reference(), "out", "source_count"), t.note(), "notebook", "note_count")


@query(sql("reference source", """SELECT s.id, title, topic, created, updated FROM v_reference r JOIN v_source s ON r."in" = s.id WHERE r.out = 'notebook:src1' ORDER BY updated DESC, s.id"""))
def notebook_sources(t: Tables) -> DataFrame:
    return relational.linked(t.reference(), t.source(), "notebook:src1").drop("parent", "full_text").orderBy(F.col("updated").desc(), "id")


@query(sql("note", "SELECT id, title, note_type, updated FROM v_note WHERE notebook = 'notebook:src1' ORDER BY updated DESC, id"))
def notebook_notes(t: Tables) -> DataFrame:
    return relational.equal(t.note(), notebook="notebook:src1").select("id", "title", "note_type", "updated").orderBy(F.col("updated").desc(), "id")


@query(sql("source source_insight source_embedding reference", """SELECT s.id, title, updated, (SELECT count(*) FROM v_source_insight i WHERE i.source = s.id) AS insights_count, EXISTS (SELECT 1 FROM v_source_embedding e WHERE e.source = s.id) AS embedded
  FROM v_source s JOIN v_reference r ON r."in" = s.id WHERE r.out = 'notebook:src2' ORDER BY updated DESC, s.id LIMIT 100"""))
def source_list_enriched(t: Tables) -> DataFrame:
    x = relational.sorted_by(relational.linked(t.reference(), t.source(), "notebook:src2"), "updated", "desc", ("created", "updated"), 100)
    x = relational.with_mark(relational.with_count(x, t.source_insight(), "source", "insights_count"), t.source_embedding(), "source", "embedded")
    return x.select("id", "title", "updated", "insights_count", "embedded")


@query(sql("reference", """SELECT "in" AS source, out AS notebook FROM v_reference"""))
def source_notebooks(t: Tables) -> DataFrame:
    return t.reference().select(F.col("in").alias("source"), F.col("out").alias("notebook"))


@query(sql("notebook", "SELECT id, name FROM v_notebook WHERE contains(lower(name), 'rc1') AND archived = false"))
def notebook_name_filter(t: Tables) -> DataFrame:
    return relational.archived(relational.contains_text(t.notebook(), "name", " RC1 "), False).select("id", "name")


@query(sql("refers_to chat_session", """SELECT s.id, title, created, updated FROM v_refers_to r JOIN v_chat_session s ON r."in" = s.id WHERE r.out = 'source:3' ORDER BY created DESC, s.id"""))
def sessions_for_source(t: Tables) -> DataFrame:
    return relational.linked(t.refers_to(), t.chat_session(), "source:3").drop("parent").orderBy(F.col("created").desc(), "id")


@query(sql("chat_session refers_to source", """SELECT c.id, s.id AS source, s.title FROM v_chat_session c LEFT JOIN v_refers_to r ON r."in" = c.id LEFT JOIN v_source s ON s.id = r.out"""))
def session_parents(t: Tables) -> DataFrame:
    parents = t.refers_to().groupBy(F.col("in").alias("session")).agg(F.min("out").alias("source"))
    x = t.chat_session().select("id").join(parents, F.col("id") == F.col("session"), "left").drop("session")
    return x.join(t.source().select(F.col("id").alias("__s"), "title"), F.col("source") == F.col("__s"), "left").select("id", F.col("__s").alias("source"), "title")


@query(sql("model", "SELECT count(*) > 0 AS found FROM v_model WHERE lower(provider) = (SELECT lower(min(provider)) FROM v_model) AND type = 'language'"))
def model_exists_ci(t: Tables) -> DataFrame:
    first = t.model().agg(F.min("provider")).first()[0]
    return relational.equal(relational.same_ignoring_case(t.model(), provider=first.upper()), type="language").limit(1).agg((F.count("*") > 0).alias("found"))


@query(sql("model", "SELECT provider, array_to_string(list_sort(list_distinct(list(type))), ',') AS types, count(*) AS models FROM v_model GROUP BY provider"))
def provider_types(t: Tables) -> DataFrame:
    return relational.types_by_provider(t.model())


@query(sql("source source_insight", """SELECT i.id, 'quality from source ' || s.title AS title, i.content FROM v_source_insight i JOIN v_source s ON s.id = i.source WHERE insight_type = 'quality'"""))
def insights_as_notes(t: Tables) -> DataFrame:
    x = t.source_insight().where("insight_type = 'quality'").join(t.source().select(F.col("id").alias("source"), F.col("title").alias("source_title")), "source")
    return x.select("id", F.concat("insight_type", F.lit(" from source "), "source_title").alias("title"), "content")


# text

@query("SELECT doc_id, sha256(regexp_replace(text, '[^\\x00-\\x7F]+', '', 'g')) AS cleaned FROM documents")
def clean_ascii(t: Tables) -> DataFrame:
    return t.raw("documents").select("doc_id", F.sha2(T.remove_non_ascii(F.col("text")).cast("binary"), 256).alias("cleaned"))


_PRINTABLE = r"""regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[\x{2000}-\x{200B}\x{202F}\x{205F}\x{3000}]', ' ', 'g'), '[\x{2028}\x{2029}\r]', chr(10), 'g'), '[^\P{C}\n\t]', '', 'g'), '\x{00A0}', ' ', 'g'), ' ' || chr(9) || chr(10)), '[^\p{L}\p{N}_\s.,!?\-]', '', 'g')"""


@query(f"SELECT doc_id, {_PRINTABLE} AS cleaned FROM documents")
def clean_printable(t: Tables) -> DataFrame:
    return t.raw("documents").select("doc_id", T.remove_non_printable(F.col("text")).alias("cleaned"))


#: Whole texts inside and outside of the marks, by turn: one block, two, none, or one that is not closed.
_THINK = "CASE turn % 4 WHEN 0 THEN '<think> ' || text || ' </think>' || text || '<think>b</think>' WHEN 1 THEN text || '<think>' || chr(10) || text || '</think>' WHEN 2 THEN ' ' || text ELSE '<think>' || text END"


@query(f"SELECT conv_id, turn, array_to_string([trim(x, ' ' || chr(9) || chr(10) || chr(13)) for x in regexp_extract_all(t, '(?s)<think>(.*?)</think>', 1)], chr(10) || chr(10)) AS thinking, CASE WHEN regexp_matches(t, '(?s)<think>.*?</think>') THEN trim(regexp_replace(regexp_replace(t, '(?s)<think>(.*?)</think>', '', 'g'), '\\n\\s*\\n\\s*\\n', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13)) ELSE t END AS cleaned FROM (SELECT *, {_THINK} AS t FROM conversations)")
def think_parse(t: Tables) -> DataFrame:
    x = t.raw("conversations").withColumn("t", F.expr(_THINK))
    return x.select("conv_id", "turn", T.thinking(F.col("t")).alias("thinking"), T.without_thinking(F.col("t")).alias("cleaned"))


@query("SELECT doc_id, floor(len(regexp_extract_all(coalesce(text, ''), '\\S+')) * 1.3::DOUBLE)::BIGINT AS tokens FROM documents")
def token_count_words(t: Tables) -> DataFrame:
    return t.raw("documents").select("doc_id", T.token_count(F.col("text")).alias("tokens"))


@query("SELECT lang, round(sum(floor(len(regexp_extract_all(coalesce(text, ''), '\\S+')) * 1.3::DOUBLE)) / 1000000 * 0.15::DOUBLE, 9) AS cost FROM documents GROUP BY lang")
def token_cost(t: Tables) -> DataFrame:
    return t.raw("documents").groupBy("lang").agg(F.round(T.token_cost(F.sum(T.token_count(F.col("text")))), 9).alias("cost"))


@query("SELECT item_id, upper(replace(text, 'ß', 'ss')) AS up, lower(text) AS low, reverse(text) AS back, 'Word count: ' || len(regexp_extract_all(text, '\\S+')) AS counted FROM benchmark")
def text_ops(t: Tables) -> DataFrame:
    c = F.col("text")
    return t.raw("benchmark").select("item_id", *[T.text_operation(c, o).alias(n) for n, o in (("up", "uppercase"), ("low", "lowercase"), ("back", "reverse"), ("counted", "word_count"))])


@query("SELECT count(value) AS count, round(sum(value), 2) AS sum, round(avg(value), 6) AS average, min(value) AS min, max(value) AS max FROM events")
def basic_stats(t: Tables) -> DataFrame:
    return relational.basic_stats(t.raw("events"), "value").withColumns({"sum": F.round("sum", 2), "average": F.round("average", 6)})


#: Texts that cite, in four shapes, each with the whole text of the document behind it.
_SHAPES = {
    0: "'See [source:d' || doc_id || '] and [[note:n' || (doc_id % 7) || ']], then source:d' || doc_id || ' or source_insight:i' || (doc_id % 3) || '.'",
    1: "'Nothing is cited in ' || doc_id || ', not even source or note:.'",
    2: "'**source:d' || doc_id || '** and [**note:n1**]; source_insight:i2, again [[source:d' || doc_id || ']]'",
    3: "'source:' || repeat('x', 101) || ' [note:a' || doc_id || ']'",
}
_CITED = "(CASE doc_id % 4 " + " ".join(f"WHEN {k} THEN {v}" for k, v in _SHAPES.items()) + " END || ' ' || coalesce(text, ''))"


def _shaped(*parts: str) -> str:
    return "SELECT doc_id, sha256(CASE doc_id % 4 " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(parts)) + " END) AS rendered FROM (SELECT *, ' ' || coalesce(text, '') AS rest, chr(10) || chr(10) || 'References:' || chr(10) AS refs FROM documents)"


@query(f"""SELECT doc_id, i - 1 AS n, split_part(key, ':', 1) AS type, split_part(key, ':', 2) AS ref FROM
  (SELECT doc_id, unnest(keys) AS key, generate_subscripts(keys, 1) AS i FROM (SELECT doc_id, regexp_extract_all({_CITED}, '(source_insight|note|source):([a-zA-Z0-9_]+)') AS keys FROM documents))""")
def citations_extract(t: Tables) -> DataFrame:
    x = t.raw("documents").select("doc_id", F.posexplode(T.citations(F.expr(_CITED))).alias("n", "c"))
    return x.select("doc_id", F.col("n").cast("long").alias("n"), "c.type", F.col("c.id").alias("ref"))


@query(_shaped(
    """'See [1](#ref-source-d' || doc_id || ') and [2](#ref-note-n' || (doc_id % 7) || '), then [1](#ref-source-d' || doc_id || ') or [3](#ref-source_insight-i' || (doc_id % 3) || ').' || rest || refs
      || '[1] - [source:d' || doc_id || '](#ref-source-d' || doc_id || ')' || chr(10) || '[2] - [note:n' || (doc_id % 7) || '](#ref-note-n' || (doc_id % 7) || ')' || chr(10) || '[3] - [source_insight:i' || (doc_id % 3) || '](#ref-source_insight-i' || (doc_id % 3) || ')'""",
    "'Nothing is cited in ' || doc_id || ', not even source or note:.' || rest",
    """'**[1](#ref-source-d' || doc_id || ')** and [**[2](#ref-note-n1)**]; [3](#ref-source_insight-i2), again [1](#ref-source-d' || doc_id || ')' || rest || refs
      || '[1] - [source:d' || doc_id || '](#ref-source-d' || doc_id || ')' || chr(10) || '[2] - [note:n1](#ref-note-n1)' || chr(10) || '[3] - [source_insight:i2](#ref-source_insight-i2)'""",
    """'[1](#ref-source-' || repeat('x', 101) || ') [2](#ref-note-a' || doc_id || ')' || rest || refs || '[1] - [source:' || repeat('x', 101) || '](#ref-source-' || repeat('x', 101) || ')' || chr(10) || '[2] - [note:a' || doc_id || '](#ref-note-a' || doc_id || ')'""",
))
def citations_number(t: Tables) -> DataFrame:
    return t.raw("documents").select("doc_id", F.sha2(T.numbered_citations(F.expr(_CITED)).cast("binary"), 256).alias("rendered"))


@query(_shaped(
    """'See [[source:d' || doc_id || ']](#ref-source-d' || doc_id || ') and [[[note:n' || (doc_id % 7) || ']]](#ref-note-n' || (doc_id % 7) || '), then [source:d' || doc_id || '](#ref-source-d' || doc_id || ') or [source_insight:i' || (doc_id % 3) || '](#ref-source_insight-i' || (doc_id % 3) || ').' || rest""",
    "'Nothing is cited in ' || doc_id || ', not even source or note:.' || rest",
    """'[**source:d' || doc_id || '**](#ref-source-d' || doc_id || ') and [[**note:n1**]](#ref-note-n1); [source_insight:i2](#ref-source_insight-i2), again [[[source:d' || doc_id || ']]](#ref-source-d' || doc_id || ')' || rest""",
    """'source:' || repeat('x', 101) || ' [[note:a' || doc_id || ']](#ref-note-a' || doc_id || ')' || rest""",
))
def citations_link(t: Tables) -> DataFrame:
    return t.raw("documents").select("doc_id", F.sha2(T.linked_citations(F.expr(_CITED)).cast("binary"), 256).alias("rendered"))


# chunks, register, context

@query()
def chunk_documents(t: Tables) -> DataFrame:
    return chunks.chunked(t.source())


@query()
def chunk_counts(t: Tables) -> DataFrame:
    return chunks.chunked(t.source()).groupBy("id").agg(F.count("*").alias("chunks"), F.max(T.token_count(F.col("content"))).alias("most_tokens"))


_TABLE = "| Product | Material Description | Result |\n|---|---|---|\n"
#: Register texts in eight shapes; {id} is the document's id and {p} a digest of its whole text.
_REGISTERS = [
    "# School {id} - Asbestos Register\n--- Page 3 ---\n## Building: H12C - Annex - 1938 - Timber\n### Area Type: Exterior\n#### Room: H12C-R004 - Porch - 17.5m²\n"
    "| Product | Material Description | Extent | Location | Friable | Condition | Risk | Result |\n|---|---|---|---|---|---|---|---|\n| {p} | Vinyl | 6m² | Floor | Non Friable | Good | Low | Detected |\n| {p}b | Lagging | 8m | Roof | Friable | Fair | Medium | Not Detected |\n"
    "#### Room: H12C-R007 - Store\n" + _TABLE + "| {p}c | Board | No asbestos |\n--- Page 4 ---\n## Building: M3 - Hall\n" + _TABLE + "| {p}d | Sheet | Unknown |\n",
    "# Site {id} - SAMP 2020\n#### Q5-R3 - Boiler Room\n| Product | Material Description |\n|---|---|\n| {p} | Panel |\n",
    "## Hall Block\n## C{id} - Main\n" + _TABLE + "| {p} | Tile | x |\n\n| {p}e | Tile | detected here |\n\n\n| {p}f | Tile | gone |\n",
    "# Yard {id}\n## Building: T40 - Block - Brick\n#### Room: T40-R210 - Lab - 55.0m²\n" + _TABLE + "| {p} | Rope | Detected |\n\n\n### Area Type: Exterior\n#### Room: T40-E006 - Eaves\n" + _TABLE + "| {p}g | Eaves | Detected |\n",
    "| | Product | Material Description | Result |\n|---|---|---|---|\n| x | {p} | Wool | Detected |\n",
    "| Name | Note |\n|---|---|\n| a | our product list |\n| Product | Material Description | Result |\n| {p} | Rope | Detected |\n",
    "# Depot {id} - ACM\n" + _TABLE + "| {p} | | Detected |\n| | Board | Detected |\n| {p}h | Board | |\n| single |\n--- Page 9 ---\n" + _TABLE + "| {p}i | Board | Detected |",
    "",
]
_FOUND = "source_id, school_name, building_id, building_name, building_year, building_construction, room_id, room_name, room_area, area_type, page_number, product, material_description, extent, location, friable, material_condition, risk_status, result"
#: What comes out of each shape, row by row: worked out by hand from the rules, not by a query.
_RECORDS = """(0, 'School {id}', 'H12C', 'Annex', 1938, 'Timber', 'H12C-R004', 'Porch', 17.5, 'Exterior', 3, '{p}', 'Vinyl', '6m²', 'Floor', 'Non Friable', 'Good', 'Low', 'Detected'),
  (0, 'School {id}', 'H12C', 'Annex', 1938, 'Timber', 'H12C-R004', 'Porch', 17.5, 'Exterior', 3, '{p}b', 'Lagging', '8m', 'Roof', 'Friable', 'Fair', 'Medium', 'Detected'),
  (0, 'School {id}', 'H12C', 'Annex', 1938, 'Timber', 'H12C-R007', 'Store', 17.5, 'Exterior', 3, '{p}c', 'Board', NULL, NULL, NULL, NULL, NULL, 'Not Detected'),
  (0, 'School {id}', 'M3', 'Hall', NULL, NULL, NULL, NULL, NULL, 'Interior', 4, '{p}d', 'Sheet', NULL, NULL, NULL, NULL, NULL, 'Unknown'),
  (1, 'Site {id}', 'Q5', 'R3', NULL, 'Boiler Room', 'Q5-R3', 'Boiler Room', NULL, 'Interior', 1, '{p}', 'Panel', NULL, NULL, NULL, NULL, NULL, ''),
  (2, '# Hall Block', 'C{id}', 'Main', NULL, NULL, 'C{id}', 'Main', NULL, 'Interior', 1, '{p}', 'Tile', NULL, NULL, NULL, NULL, NULL, 'x'),
  (2, '# Hall Block', 'C{id}', 'Main', NULL, NULL, 'C{id}', 'Main', NULL, 'Interior', 1, '{p}e', 'Tile', NULL, NULL, NULL, NULL, NULL, 'Detected'),
  (3, 'Yard {id}', 'T40', 'Block', NULL, 'Brick', 'T40-R210', 'Lab', 55.0, 'Interior', 1, '{p}', 'Rope', NULL, NULL, NULL, NULL, NULL, 'Detected'),
  (3, 'Yard {id}', 'T40', 'Block', NULL, 'Brick', 'T40-R210', 'Lab', 55.0, 'Exterior', 1, '{p}g', 'Eaves', NULL, NULL, NULL, NULL, NULL, 'Detected'),
  (4, 'Unknown School', 'Unknown', NULL, NULL, NULL, NULL, NULL, NULL, 'Interior', 1, 'x', '{p}', NULL, NULL, NULL, NULL, NULL, 'Wool'),
  (6, 'Depot {id}', 'Unknown', NULL, NULL, NULL, NULL, NULL, NULL, 'Interior', 1, '{p}h', 'Board', NULL, NULL, NULL, NULL, NULL, ''),
  (6, 'Depot {id}', 'Unknown', NULL, NULL, NULL, NULL, NULL, NULL, 'Interior', 9, '{p}i', 'Board', NULL, NULL, NULL, NULL, NULL, 'Detected')"""
_FILLED = "replace(replace({0}, '{{id}}', doc_id::VARCHAR), '{{p}}', md5(coalesce(text, '')))"
_REGISTER_SQL = f"""SELECT 'source:' || doc_id AS source_id, {_FILLED.format('e.school_name')} AS school_name, {_FILLED.format('e.building_id')} AS building_id, building_name, building_year::INTEGER AS building_year, building_construction,
  {_FILLED.format('e.room_id')} AS room_id, room_name, room_area::DOUBLE AS room_area, area_type, page_number::INTEGER AS page_number, {_FILLED.format('e.product')} AS product, {_FILLED.format('e.material_description')} AS material_description, extent, location, friable, material_condition, risk_status, result
  FROM documents JOIN (VALUES {_RECORDS}) e(shape, {_FOUND.removeprefix('source_id, ')}) ON doc_id % 8 = shape"""


def _registers(t: Tables) -> DataFrame:
    shape = F.element_at(F.array(*map(F.lit, _REGISTERS)), (F.col("doc_id") % 8 + 1).cast("int"))
    text = F.replace(F.replace(shape, F.lit("{id}"), F.col("doc_id").cast("string")), F.lit("{p}"), F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    return t.raw("documents").select(F.expr("concat('source:', doc_id)").alias("id"), text.alias("full_text"))


@query(_REGISTER_SQL)
def register_extract(t: Tables) -> DataFrame:
    return register.extract_records(_registers(t)).select(*_FOUND.split(", "))


@query(f"SELECT source_id, count(*) FILTER (result <> '') AS valid, count(*) FILTER (result = '') AS failed FROM ({_REGISTER_SQL}) GROUP BY source_id")
def register_from_texts(t: Tables) -> DataFrame:
    x = register.validated(register.extract_records(_registers(t)))
    return x.groupBy("source_id").agg(F.count_if("valid").alias("valid"), F.count_if(~F.col("valid")).alias("failed"))


@query(f"SELECT count(*) FILTER (result <> '') AS created, (SELECT count(*) FROM documents WHERE doc_id % 2 = 0 AND doc_id % 8 <> 7) AS deleted, count(*) FILTER (result = '') AS failed FROM ({_REGISTER_SQL})")
def register_tally(t: Tables) -> DataFrame:
    old = t.raw("documents").where("doc_id % 2 = 0").select(F.expr("concat('source:', doc_id)").alias("source_id"))
    return register.extraction_tally(_registers(t), old)


_ITEMS = """, i AS (SELECT r.out AS notebook, s.id, 'source' AS type, s.title AS content, 100 AS priority, 0 AS k FROM v_reference r JOIN v_source s ON s.id = r."in"
  UNION ALL SELECT r.out, x.id, 'insight', x.insight_type || ': ' || x.content, 75, 1 FROM v_reference r JOIN v_source_insight x ON x.source = r."in"
  UNION ALL SELECT notebook, id, 'note', title || chr(10) || content, 50, 2 FROM v_note),
  m AS (SELECT *, floor(len(regexp_extract_all(content, '\\S+')) * 1.3::DOUBLE)::BIGINT AS tokens FROM i),
  o AS (SELECT *, sum(tokens) OVER (PARTITION BY notebook ORDER BY priority DESC, k, id)::BIGINT AS upto FROM m)"""


def _items(t: Tables) -> DataFrame:
    return context.notebook_items(t.reference(), t.source(), t.source_insight(), t.note())


@query(sql("reference source source_insight note", _ITEMS + " SELECT notebook, id, type, priority, tokens, upto FROM o"))
def context_priority(t: Tables) -> DataFrame:
    return context.assemble(_items(t), by="notebook").select("notebook", "id", "type", "priority", "tokens", "upto")


@query(sql("reference source source_insight note", _ITEMS + " SELECT notebook, id, tokens FROM o WHERE upto <= 1000"))
def context_truncate(t: Tables) -> DataFrame:
    return context.assemble(_items(t), 1000, "notebook").select("notebook", "id", "tokens")


@query(sql("reference source source_insight note", _ITEMS + """ SELECT notebook, count(*) FILTER (type = 'source') AS sources, count(*) FILTER (type = 'insight') AS insights, count(*) FILTER (type = 'note') AS notes, count(*) AS total_items, sum(tokens)::BIGINT AS total_tokens
  FROM o WHERE upto <= 1000 GROUP BY notebook"""))
def context_notebook(t: Tables) -> DataFrame:
    return context.response(context.assemble(_items(t), 1000, "notebook"))


# writes

@query(sql("notebook", """SELECT id, name, CASE WHEN name LIKE '%2' THEN 'new ' || name ELSE description END AS description, archived FROM v_notebook UNION ALL SELECT 'notebook:new', 'new', NULL, NULL"""))
def merge_upsert(t: Tables) -> DataFrame:
    patch = t.notebook().where("name LIKE '%2'").select("id", F.lit(None).cast("string").alias("name"), F.concat(F.lit("new "), "name").alias("description"))
    new = t.notebook().limit(1).select(F.lit("notebook:new").alias("id"), F.lit("new").alias("name"), F.lit(None).cast("string").alias("description"))
    return writes.merged(t.notebook(), patch.unionByName(new), insert=True)


@query(sql("source_embedding source_insight", """SELECT 'chunk' AS kind, count(*) AS left_over FROM v_source_embedding WHERE source NOT IN (SELECT 'source:' || doc_id FROM documents WHERE doc_id % 2 = 0)
  UNION ALL SELECT 'insight', count(*) FROM v_source_insight WHERE source NOT IN (SELECT 'source:' || doc_id FROM documents WHERE doc_id % 2 = 0)"""))
def cascade_delete(t: Tables) -> DataFrame:
    gone = t.raw("documents").where("doc_id % 2 = 0").select(F.expr("concat('source:', doc_id)").alias("key"))
    left = writes.cascade({"chunk": (t.source_embedding(), "source"), "insight": (t.source_insight(), "source")}, gone)
    parts = [df.agg(F.count("*").alias("left_over")).select(F.lit(k).alias("kind"), "left_over") for k, df in left.items()]
    return parts[0].unionByName(parts[1])


@query(sql("acm_record", "SELECT count(*) AS deleted FROM v_acm_record WHERE building_id IN ('B1', 'B2')"))
def delete_count(t: Tables) -> DataFrame:
    keys = t.acm_record().where("building_id IN ('B1', 'B2')").select(F.col("building_id").alias("key"))
    return writes.deleted_count(t.acm_record(), keys, "building_id")


@query(sql("reference", """SELECT * FROM v_reference UNION SELECT "in", 'notebook:extra' FROM v_reference WHERE out = 'notebook:src1'"""))
def insert_if_absent_edges(t: Tables) -> DataFrame:
    r = t.reference()
    new = r.where("out = 'notebook:src1'")
    return writes.linked_once(r, new.unionByName(new.withColumn("out", F.lit("notebook:extra"))))


_EXISTING = """SELECT DISTINCT 'source' AS type, source AS id FROM v_source_embedding WHERE len(embedding) > 0 UNION ALL SELECT 'note', id FROM v_note WHERE len(embedding) > 0 UNION ALL SELECT 'insight', id FROM v_source_insight WHERE len(embedding) > 0"""
_ALL = """SELECT 'source' AS type, id FROM v_source WHERE full_text <> '' UNION ALL SELECT 'note', id FROM v_note WHERE content <> '' UNION ALL SELECT 'insight', id FROM v_source_insight"""


def _to_embed(t: Tables, existing: bool) -> DataFrame:
    return models.to_embed(t.source(), t.source_embedding(), t.note(), t.source_insight(), existing)


@query(sql("source source_embedding note source_insight", _EXISTING))
def rebuild_select_existing(t: Tables) -> DataFrame:
    return _to_embed(t, True)


@query(sql("source source_embedding note source_insight", _ALL))
def rebuild_select_all(t: Tables) -> DataFrame:
    return _to_embed(t, False)


@query(sql("source source_embedding note source_insight", f"SELECT type, count(*) AS processed FROM ({_ALL}) GROUP BY type"))
def rebuild_tally(t: Tables) -> DataFrame:
    return _to_embed(t, False).groupBy("type").agg(F.count("*").alias("processed"))


# jobs

@query(sql("job", "SELECT job_id, arg_max(status, (ts, event_id)) AS status FROM v_job GROUP BY job_id"))
def job_latest_status(t: Tables) -> DataFrame:
    return jobs.latest_status(t.job()).select("job_id", "status")


@query(sql("job", "SELECT job_id, count(*) FILTER (status = 'completed') AS processed, count(*) FILTER (status = 'failed') AS failed, count(*) AS total, round(100.0::DOUBLE * count(*) FILTER (status = 'completed') / count(*), 2) AS percent FROM v_job GROUP BY job_id"))
def job_progress(t: Tables) -> DataFrame:
    return jobs.progress(t.job())


@query(sql("job", "SELECT job_id, status FROM (SELECT job_id, arg_max(status, (ts, event_id)) AS status, max(ts) AS ts FROM v_job GROUP BY job_id) WHERE status = 'failed' ORDER BY ts DESC, job_id LIMIT 20"))
def job_list_filtered(t: Tables) -> DataFrame:
    return jobs.listed(t.job(), "failed", 20).select("job_id", "status")


@query(sql("job", """SELECT job_id, CASE status WHEN 'completed' THEN 'Source processing completed successfully' WHEN 'failed' THEN 'Source processing failed' WHEN 'running' THEN 'Source processing in progress' ELSE 'Source processing queued' END AS message
  FROM (SELECT job_id, arg_max(status, (ts, event_id)) AS status FROM v_job GROUP BY job_id)"""))
def job_messages(t: Tables) -> DataFrame:
    return jobs.latest_status(t.job()).select("job_id", relational.status_message(F.col("status")).alias("message"))


# models and sources

@query("SELECT doc_id, CASE WHEN n_chars > 5000 THEN 'large' ELSE coalesce(CASE WHEN lang = 'en' THEN 'english' END, 'default') END AS model FROM documents")
def model_route(t: Tables) -> DataFrame:
    asked = F.when(F.col("lang") == "en", "english")
    return t.raw("documents").select("doc_id", T.route_model(F.col("n_chars"), asked, F.lit("default"), F.lit("large"), 5000).alias("model"))


@query("SELECT 'source:' || doc_id AS source, p.insight_type, sha256(p.prompt || text) AS content FROM documents, (VALUES ('Digest', 'all of it: '), ('Second', 'once more: ')) p(insight_type, prompt) WHERE text IS NOT NULL")
def transform_apply(t: Tables) -> DataFrame:
    def answer(asked: list[tuple[str, str]]) -> list[str]:
        return [hashlib.sha256((prompt + text).encode()).hexdigest() for prompt, text in asked]

    return models.transformed(t.source(), [("Digest", "all of it: "), ("Second", "once more: ")], answer)


_PAGE = r"""regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<head\b.*?</head\s*>', ' ', 'g')"""
_PAGE = rf"""regexp_replace(regexp_replace({_PAGE}, '(?i)<(?:br|/p|/div|/li|/h[1-6]|/tr)\b[^>]*>', chr(10), 'g'), '(?s)<[^>]*>', ' ', 'g')"""
for _entity, _char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
    _PAGE = f"replace({_PAGE}, '{_entity}', '{_char}')"
_PAGE = rf"""regexp_replace(regexp_replace(regexp_replace({_PAGE}, '[ \t]+', ' ', 'g'), ' ?\n\s*', chr(10), 'g'), '^\s+|\s+$', '', 'g')"""


@query(f"SELECT 'source:page' || page_id AS id, nullif(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '') AS title, url, {_PAGE} AS full_text FROM pages")
def link_sources(t: Tables) -> DataFrame:
    return files.link_sources(t.raw("pages"))


@query("""SELECT 'data: {"item_id":' || item_id || ',"type":"answer"}' || chr(10) || chr(10) AS frame FROM benchmark""")
def event_frames(t: Tables) -> DataFrame:
    return files.event_frames(t.raw("benchmark").select("item_id", F.lit("answer").alias("type")))


# more links and filters

@query(sql("source_embedding source", "SELECT e.id, s.id AS source, s.title FROM v_source_embedding e JOIN v_source s ON s.id = e.source"))
def chunk_parents(t: Tables) -> DataFrame:
    parents = t.source().select(F.col("id").alias("source"), "title")
    return t.source_embedding().select("id", "source").join(parents, "source").select("id", "source", "title")


@query(sql("source reference", """SELECT id, id IN (SELECT "in" FROM v_reference WHERE out = 'notebook:src1') AS linked FROM v_source"""))
def already_linked(t: Tables) -> DataFrame:
    return relational.with_mark(t.source().select("id"), relational.equal(t.reference(), out="notebook:src1"), "in", "linked")


@query(sql("chat_session refers_to", """SELECT id, title FROM v_chat_session WHERE EXISTS (SELECT 1 FROM v_refers_to WHERE "in" = id AND out = 'source:3')"""))
def session_belongs(t: Tables) -> DataFrame:
    edges = relational.equal(t.refers_to(), out="source:3").select(F.col("in").alias("id"))
    return t.chat_session().select("id", "title").join(edges, "id", "left_semi")


@query(sql("source job", """SELECT s.id, coalesce(j.status, 'unknown') AS status FROM v_source s LEFT JOIN (SELECT job_id, arg_max(status, (ts, event_id)) AS status FROM v_job GROUP BY job_id) j ON j.job_id = replace(s.id, 'source:', 'command:')"""))
def source_status(t: Tables) -> DataFrame:
    x = t.source().select("id", F.replace("id", F.lit("source:"), F.lit("command:")).alias("job_id"))
    return jobs.status_of(x, t.job()).select("id", "status")


@query(sql("source_embedding", "SELECT count(DISTINCT source) AS embedded FROM v_source_embedding WHERE embedding IS NOT NULL AND len(embedding) > 0"))
def embedded_source_count(t: Tables) -> DataFrame:
    return t.source_embedding().where("size(embedding) > 0").agg(F.count_distinct("source").alias("embedded"))


@query(sql("acm_record", "SELECT id, product, result FROM v_acm_record WHERE contains(lower(product), 'a') AND result = 'N' ORDER BY product DESC, id LIMIT 100 OFFSET 20"))
def grid_filter_sort(t: Tables) -> DataFrame:
    x = relational.contains_text(relational.equal(t.acm_record(), result="N"), "product", " A ")
    return relational.sorted_by(x, "product", "desc", ("product", "result"), 100, 20).select("id", "product", "result")


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN NULL WHEN p_size % 3 = 1 THEN p_partkey IN (SELECT s_suppkey FROM supplier) ELSE false END AS file_available FROM part")
def file_available(t: Tables) -> DataFrame:
    base = t.raw("part").select("p_partkey", "p_size")
    path = F.expr("CASE p_size % 3 WHEN 1 THEN concat('/uploads/', p_partkey) WHEN 2 THEN concat('/other/', p_partkey) END")
    files_there = t.raw("supplier").selectExpr("concat('/uploads/', s_suppkey) AS path")
    return relational.available(path, "/uploads/", files_there, base).drop("p_size")


# more text

@query("""SELECT p_partkey, 'source:' || p_partkey AS prefixed, nullif(trim(CASE WHEN p_size % 4 = 0 THEN '  ' ELSE ' ' || p_name END), '') AS required, len(string_split(p_name, 'a'))::BIGINT AS parts, left(p_name, 8) AS short,
  CASE WHEN length(p_name) > 10 THEN left(p_name, 10) || '...' ELSE p_name END AS cut, p_size % 2 = 1 AS truthy, 'acm_export_' || replace(p_name, ' ', '_') || '.csv' AS export_name FROM part""")
def text_scalars(t: Tables) -> DataFrame:
    c, odd = F.col, F.col("p_size") % 2 == 1
    key = c("p_partkey").cast("string")
    return t.raw("part").select(
        "p_partkey", T.with_prefix(F.when(odd, key).otherwise(F.concat(F.lit("source:"), key)), "source").alias("prefixed"),
        T.required(F.when(c("p_size") % 4 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), "p_name"))).alias("required"), F.size(T.comma_list(F.replace("p_name", F.lit("a"), F.lit(",")))).cast("long").alias("parts"),
        T.short(c("p_name"), 8).alias("short"), T.cut(c("p_name"), 10, "...").alias("cut"), T.truthy(F.when(odd, F.lit("Yes")).otherwise(F.lit("off"))).alias("truthy"), files.export_name(c("p_name")).alias("export_name"),
    )


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 < 3 THEN 'owner' || p_size END AS owner, CASE WHEN p_partkey % 5 < 3 THEN 'repo' || p_partkey END AS name FROM part")
def repository_urls(t: Tables) -> DataFrame:
    url = F.expr("CASE p_partkey % 5 WHEN 0 THEN 'https://github.com/' WHEN 1 THEN 'http://www.github.com/' WHEN 2 THEN 'https://github.com//' WHEN 3 THEN 'https://gitlab.example.com/' ELSE 'https://github.com/?' END || 'owner' || p_size || '/repo' || p_partkey || CASE p_size % 3 WHEN 0 THEN '/' WHEN 1 THEN '/tree/main?x=1' ELSE '' END")
    return t.raw("part").select("p_partkey", T.repository_of(url).alias("r")).select("p_partkey", "r.owner", "r.name")


#: Pairs of versions and how they compare, worked out by hand; {n} is a number of the row.
_VERSIONS = [
    ("v{n}.1", "{n}.2.0", -1), ("1.0", "1.0.0", 0), ("1.2", "1.10", -1), ("1.0a1", "1.0b1", -1), ("1.0rc2", "1.0rc10", -1), ("1.0", "1.0rc1", 1), ("1.0.post1", "1.0", 1), ("1.0.dev3", "1.0a1", -1), ("1!0.1", "2024.9", 1), ("1.0+local.2", "1.0", 1),
    ("1.0+local.2", "1.0+local.10", -1), ("1.0+5", "1.0+abc", 1), ("1.2.3.4.5.6.7.8.9.10.11.12.13.{n}", "1.2.3.4.5.6.7.8.9.10.11.12.13", 1), ("1.2.3.4.5.6.7.8.9.10.11.12.13", "1.2.3.4.5.6.7.8.9.10.11.12.14", -1), ("{n}.0.0", "{n}", 0), ("2.0.post2", "2.0.post10", -1),
]


@query(f"SELECT p_partkey, ({[s for _, _, s in _VERSIONS]!r})[p_partkey % {len(_VERSIONS)} + 1] AS sign FROM part")
def versions_compared(t: Tables) -> DataFrame:
    pick = lambda k: F.replace(F.element_at(F.array(*[F.lit(v[k]) for v in _VERSIONS]), (F.col("p_partkey") % len(_VERSIONS) + 1).cast("int")), F.lit("{n}"), (F.col("p_size") + 1).cast("string"))
    return t.raw("part").select("p_partkey", T.compare_versions(pick(0), pick(1)).alias("sign"))


#: Parts of a version that a row's numbers give, smaller ones first; a version is written from them, so SQL compares the parts themselves.
_PARTS = {"e": "{0} % 7 // 6", "a": "{0} % 3", "b": "{0} * 7 % 11", "c": "{0} // 5 % 2", "stage": "{0} * 5 % 6", "k": "CASE WHEN {0} * 5 % 6 = 4 THEN 0 ELSE {0} % 12 + 1 END"}


def _parts(key: str) -> str:
    return "(" + ", ".join(f"({v.format(f'({key})')})::BIGINT" for v in _PARTS.values()) + ")"


@query(f"""SELECT o_orderkey, CASE WHEN x < y THEN -1 WHEN x > y THEN 1 ELSE 0 END AS sign FROM (SELECT o_orderkey, row{_parts('o_orderkey')} AS x, row{_parts('o_orderkey * 3 + o_custkey')} AS y FROM orders)""")
def versions_generated(t: Tables) -> DataFrame:
    """Versions of all stages and spellings: 1!2.0.3rc4, V2.3.a1, 2.3.0-beta.2, 2.post3, 2.0.dev1."""

    def written(key: str) -> F.Column:
        part = {n: F.expr(f"cast({v.format(f'({key})').replace('//', 'div')} AS bigint)") for n, v in _PARTS.items()}
        text = {n: c.cast("string") for n, c in part.items()}
        head = F.when(F.expr(f"({key}) % 4 = 0"), "v").when(F.expr(f"({key}) % 4 = 1"), " V").otherwise("")
        release = F.concat(text["a"], F.when((part["b"] > 0) | (part["c"] > 0), F.concat(F.lit("."), text["b"])).otherwise(""), F.when(part["c"] > 0, F.concat(F.lit("."), text["c"])).otherwise(F.when(F.expr(f"({key}) % 5 = 0") & (part["b"] > 0), ".0").otherwise("")))
        names = [[".dev"], ["a", "-alpha.", ".a", "alpha"], ["b", "-beta.", "_b", "BETA"], ["rc", "-rc.", "c", ".pre"], [""], [".post"]]
        stage = None
        for k, spelt in enumerate(names):
            name = F.get(F.array(*map(F.lit, spelt)), F.expr(f"cast(({key}) % {len(spelt)} AS int)"))
            stage = F.when(part["stage"] == k, name) if stage is None else stage.when(part["stage"] == k, name)
        return F.concat(head, F.when(part["e"] > 0, F.concat(text["e"], F.lit("!"))).otherwise(""), release, stage, F.when(part["stage"] != 4, text["k"]).otherwise(""))

    return t.raw("orders").select("o_orderkey", T.compare_versions(written("o_orderkey"), written("o_orderkey * 3 + o_custkey")).alias("sign"))


@query("""SELECT (doc_id // 20)::VARCHAR AS folder, sha256(string_agg('## ' || doc_id || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY doc_id::VARCHAR)) AS digest FROM documents GROUP BY ALL HAVING count(text) > 0""")
def docs_consolidated(t: Tables) -> DataFrame:
    x = t.raw("documents").where("text IS NOT NULL").selectExpr("concat('docs/', doc_id div 20, '/', doc_id, '.md') AS path", "text AS full_text")
    return files.consolidated(x).select("folder", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))


# more writes

@query(sql("notebook", "SELECT id, name, CASE WHEN archived THEN 'old' ELSE description END AS description, archived FROM v_notebook"))
def merge_update(t: Tables) -> DataFrame:
    patch = t.notebook().where("archived").select("id", F.lit(None).cast("string").alias("name"), F.lit("old").alias("description"))
    return writes.merged(t.notebook(), patch.unionByName(patch.limit(0)))


@query(sql("notebook", "SELECT 'fresh' AS batch, count(*) * 2 AS rows FROM v_notebook UNION ALL SELECT 'taken', count(*) FROM v_notebook"))
def insert_batches(t: Tables) -> DataFrame:
    n = t.notebook()
    new = n.withColumn("id", F.concat("id", F.lit("-new")))
    count = lambda rows, name: writes.insert_batch(n, rows).agg(F.count("*").alias("rows")).select(F.lit(name).alias("batch"), "rows")
    return count(new, "fresh").unionByName(count(new.unionByName(n), "taken"))


@query(sql("reference", """SELECT * FROM v_reference WHERE out <> 'notebook:src1'"""))
def edges_unlinked(t: Tables) -> DataFrame:
    return writes.unlinked(t.reference(), relational.equal(t.reference(), out="notebook:src1"))


@query(sql("job", "SELECT job_id, 'cancelled' AS status FROM v_job GROUP BY job_id HAVING arg_max(status, (ts, event_id)) IN ('new', 'queued', 'running')"))
def jobs_cancelled(t: Tables) -> DataFrame:
    log = t.job().select("job_id", "event_id", "ts", "status")
    return jobs.cancelled(log, log, "2030-01-01").where("status = 'cancelled'").select("job_id", "status")


from . import records  # noqa: E402,F401
