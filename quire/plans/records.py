"""Queries of record lookups, profiles, episodes, contexts of requests, prompts, conversations and file names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import commands, context, models, providers, register, relational, search, validation, writes
from ..sources import files
from ..sources.markdown import page_markdown
from ..streaming import jobs
from .registry import query
from .views import MODEL_TYPES, Tables, sql

# lookups


@query(sql("notebook source", """SELECT 'notebook' AS table, id, NULL::VARCHAR AS title FROM v_notebook WHERE id IN ('notebook:src1', 'notebook:src3') UNION ALL SELECT 'source', id, title FROM v_source WHERE id IN ('source:3', 'source:11')"""))
def records_by_prefix(t: Tables) -> DataFrame:
    ids = t.spark.createDataFrame([("notebook:src1",), ("notebook:src3",), ("source:3",), ("source:11",), ("source:3",), ("source:none",), ("other:1",)], "id string")
    tables = {"notebook": t.notebook().withColumn("title", F.lit(None).cast("string")), "source": t.source()}
    return relational.records(tables, ids, ["id", "title"])


@query(sql("source", "SELECT id, title, topic FROM v_source WHERE id = 'source:7'"))
def record_point(t: Tables) -> DataFrame:
    return relational.record({"source": t.source(), "notebook": t.notebook()}, "source:7").select("id", "title", "topic")


@query(sql("notebook", "SELECT 'notebook:src2' AS id, coalesce((SELECT name FROM v_notebook WHERE id = 'notebook:src2'), 'none') AS name, 'a default' AS view UNION ALL SELECT 'notebook:absent', 'none', 'a default'"))
def record_singleton(t: Tables) -> DataFrame:
    n = t.notebook().withColumn("view", F.lit(None).cast("string"))
    one = lambda id: relational.singleton(n, id, {"name": "none", "view": "a default"})
    return one("notebook:src2").unionByName(one("notebook:absent"))


@query(sql("source", "SELECT id, title FROM v_source WHERE topic = 'de' AND created >= 1704070800"))
def query_with_arguments(t: Tables) -> DataFrame:
    return relational.bound_query(t.spark, "SELECT id, title FROM {source} WHERE topic = :topic AND created >= :since", {"source": t.source()}, topic="de", since=1704070800)


@query(sql("model", "SELECT id, name, provider FROM v_model WHERE trim(name) <> '' AND id NOT LIKE '%7'"))
def records_valid_only(t: Tables) -> DataFrame:
    broken = t.model().withColumn("provider", F.when(F.endswith("id", F.lit("7")), F.lit("  ")).otherwise(F.col("provider")))
    return relational.scanned(broken, ("name", "provider"), [F.col("name"), F.col("id")]).select("id", "name", "provider")


@query(sql("source", "SELECT id, updated FROM v_source ORDER BY updated DESC, id LIMIT 25"))
def order_by_clause(t: Tables) -> DataFrame:
    return t.source().select("id", "updated").orderBy(*relational.order_clause("updated desc", ("updated", "created"))).limit(25)


@query(sql("artifact note", """SELECT n.id, n.title, n.updated FROM v_artifact a JOIN v_note n ON n.id = a."in" WHERE a.out = 'notebook:src1' ORDER BY n.updated DESC, n.id"""))
def notes_through_edges(t: Tables) -> DataFrame:
    x = relational.linked(t.artifact(), t.note(), "notebook:src1").select(F.struct("id", "title", "updated").alias("note"))
    return relational.by_field(x, "note.updated", "desc", "note.id").select("note.*")


@query(sql("refers_to chat_session", """SELECT s.id, s.title, s.updated FROM v_refers_to r JOIN v_chat_session s ON r."in" = s.id WHERE replace(r.out, 'source:', 'notebook:src') = 'notebook:src3' ORDER BY s.updated DESC, s.id"""))
def sessions_for_notebook(t: Tables) -> DataFrame:
    edges = t.refers_to().withColumn("out", F.replace("out", F.lit("source:"), F.lit("notebook:src")))
    return relational.linked(edges, t.chat_session(), "notebook:src3").select("id", "title", "updated").orderBy(F.col("updated").desc(), "id")


@query(sql("source", "SELECT id, updated, (SELECT count(*) FROM v_source) >= 90 AS has_more FROM v_source ORDER BY updated DESC, id LIMIT 30 OFFSET 60"))
def sources_scrolled(t: Tables) -> DataFrame:
    return relational.scrolled(t.source().select("id", "updated"), [F.col("updated").desc(), F.col("id")], 60, 30)


@query(sql("source source_embedding", """SELECT id, round(coalesce(CASE WHEN k % 3 = 0 THEN created / 1e9 END, CASE WHEN k % 3 <> 2 THEN updated / 1e9 END, 0.0), 6) AS final_score FROM (SELECT *, substr(id, 8)::BIGINT AS k FROM v_source)"""))
def results_resorted(t: Tables) -> DataFrame:
    k = F.substring("id", 8, 20).cast("long")
    x = t.source().select("id", F.when(k % 3 == 0, F.col("created") / 1e9).alias("relevance"), F.when(k % 3 != 2, F.col("updated") / 1e9).alias("similarity"))
    return search.resorted(x).select("id", F.round("final_score", 6).alias("final_score"))


@query(sql("model", f"SELECT id, type FROM v_model WHERE type IN {tuple(MODEL_TYPES)!r}"))
def model_types_checked(t: Tables) -> DataFrame:
    return t.model().select("id", T.among(F.col("type"), tuple(MODEL_TYPES), "model type").alias("type"))


@query(sql("source_insight", "SELECT source, arg_max(id, (insight_type, id)) AS id, max(insight_type) AS insight_type FROM v_source_insight GROUP BY source"))
def insight_latest(t: Tables) -> DataFrame:
    return relational.latest(t.source_insight().select("id", "source", "insight_type"), "source", ["insight_type", "id"]).select("source", "id", "insight_type")


# profiles, episodes, commands


@query(sql("episode_profile speaker_profile", "SELECT e.id, e.speaker_config, s.speakers FROM v_episode_profile e JOIN v_speaker_profile s ON s.name = e.speaker_config"))
def profiles_with_speakers(t: Tables) -> DataFrame:
    return relational.with_profile(t.episode_profile(), t.speaker_profile()).select("id", "speaker_config", "speakers")


@query(sql("episode_profile", "SELECT id, default_briefing || CASE WHEN coalesce(suffix, '') <> '' THEN chr(10) || chr(10) || 'Additional instructions: ' || suffix ELSE '' END AS briefing FROM v_episode_profile"))
def briefings(t: Tables) -> DataFrame:
    return t.episode_profile().select("id", T.briefing(F.col("default_briefing"), F.col("suffix")).alias("briefing"))


@query(sql("episode_profile", "SELECT id || '-copy' AS id, name || ' - Copy' AS name, speaker_config FROM v_episode_profile WHERE speaker_config = 'speaker 3'"))
def profiles_cloned(t: Tables) -> DataFrame:
    p = t.episode_profile().select("id", "name", "speaker_config")
    return writes.cloned(p, "id", p.where("speaker_config = 'speaker 3'").select(F.col("id").alias("key"), F.concat("id", F.lit("-copy")).alias("new_key")))


@query(sql("speaker_profile", "SELECT id, name FROM v_speaker_profile UNION ALL SELECT 'speaker_profile:seed', 'seed'"))
def profiles_seeded(t: Tables) -> DataFrame:
    p = t.speaker_profile().select("id", "name")
    seed = p.orderBy("id").limit(1).withColumn("name", F.lit("not this one")).unionByName(t.spark.createDataFrame([("speaker_profile:seed", "seed")], "id string, name string"))
    return writes.seeded(p, seed)


@query("SELECT p_brand AS app_id, string_agg(p_name, ',' ORDER BY p_name) AS names, count(*) AS commands FROM part GROUP BY p_brand")
def commands_registered(t: Tables) -> DataFrame:
    return relational.commands_by_app(t.raw("part").select(F.col("p_brand").alias("app_id"), F.col("p_name").alias("name")))


@query(sql("episode job", """SELECT e.id, CASE WHEN coalesce(command, '') = '' THEN 'completed' ELSE coalesce(j.status, 'unknown') END AS job_status FROM v_episode e LEFT JOIN (SELECT job_id, arg_max(status, (ts, event_id)) AS status FROM v_job GROUP BY job_id) j ON j.job_id = e.command
  WHERE coalesce(command, '') <> '' OR coalesce(audio_file, '') <> ''"""))
def episodes_listed(t: Tables) -> DataFrame:
    return relational.listed_episodes(t.episode(), jobs.latest_status(t.job())).select("id", "job_status")


@query(sql("job", "SELECT job_id, arg_max(status, (ts, event_id)) AS status FROM v_job GROUP BY job_id UNION ALL SELECT 'command:fresh', 'new'"))
def jobs_submitted(t: Tables) -> DataFrame:
    log = t.job().select("job_id", "event_id", "ts", "status")
    asked = log.select("job_id").limit(1).unionByName(t.spark.createDataFrame([("command:fresh",), ("command:fresh",)], "job_id string"))
    return jobs.latest_status(jobs.submitted(log, asked, "2030-01-01")).select("job_id", "status")


# texts and prompts

_PROMPT = "# QUESTION\n\n{{question}}\n\n# SEARCH\n\n{{ term }}\n\n# RESULTS\n\n{{results}}\n\nIds: {{ids}}\n"


@query("SELECT item_id, '# QUESTION' || chr(10) || chr(10) || text || chr(10) || chr(10) || '# SEARCH' || chr(10) || chr(10) || upper(left(text, 5)) || chr(10) || chr(10) || '# RESULTS' || chr(10) || chr(10) || '{{ids}}' || chr(10) || chr(10) || 'Ids: ' || item_id || chr(10) AS prompt FROM benchmark")
def prompts_rendered(t: Tables) -> DataFrame:
    prompt = T.rendered(_PROMPT, question=F.col("text"), term=T.upper_each(F.substring("text", 1, 5)), results=F.lit("{{ids}}"), ids=F.col("item_id"))
    return t.raw("benchmark").select("item_id", prompt.alias("prompt"))


@query("SELECT p_partkey, p_size % 4 AS n, i - 1 AS place, v AS value FROM (SELECT p_partkey, p_size, unnest(list_slice(['a', p_name, 'c'], 1, p_size % 4)) AS v, generate_subscripts(list_slice(['a', p_name, 'c'], 1, p_size % 4), 1) AS i FROM part)")
def json_lists(t: Tables) -> DataFrame:
    text = F.when(F.col("p_size") % 4 > 0, F.to_json(F.slice(F.array(F.lit("a"), "p_name", F.lit("c")), 1, F.col("p_size") % 4))).otherwise("")
    x = t.raw("part").select("p_partkey", (F.col("p_size") % 4).alias("n"), F.posexplode(T.json_array(text)).alias("place", "value"))
    return x.select("p_partkey", "n", F.col("place").cast("long").alias("place"), "value")


@query("""SELECT s_suppkey, '{"s_suppkey":' || s_suppkey || ',"inner":{"s_name":"' || s_name || '"}}' AS dumped FROM supplier""")
def rows_dumped(t: Tables) -> DataFrame:
    return t.raw("supplier").withColumn("inner", F.struct("s_name")).select("s_suppkey", T.whole_json("s_suppkey", "inner").alias("dumped"))


@query("SELECT event_id, strftime(ts, '%Y%m%d%H%M%S') AS stamp, ts AS parsed, NULL::TIMESTAMP AS broken FROM events")
def times(t: Tables) -> DataFrame:
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return t.raw("events").select("event_id", T.stamp(F.col("ts")).alias("stamp"), T.parsed_time(iso).cast("timestamp_ntz").alias("parsed"), T.parsed_time(F.lit("no time")).cast("timestamp_ntz").alias("broken"))


@query(sql("note", """SELECT id, CASE WHEN note_type = 'ai' AND content <> '' AND hash_even THEN 'Title of ' || length(content) WHEN hash_even THEN '' ELSE title END AS title FROM (SELECT *, updated % 2 = 0 AS hash_even FROM v_note)"""))
def notes_titled(t: Tables) -> DataFrame:
    bare = t.note().select("id", F.when(F.col("updated") % 2 == 0, "").otherwise(F.col("title")).alias("title"), "note_type", "content")
    return models.titled(bare, lambda asked: [f"Title of {len(text)}" for _, text in asked], "a title").select("id", "title")


# contexts of requests

_JSON = """'{"id":"' || s.id || '"' || coalesce(',"title":' || to_json(s.title), '') || ',"insights":[' || coalesce((SELECT string_agg('{"id":"' || i.id || '","insight_type":"' || i.insight_type || '","content":"' || i.content || '"}', ',' ORDER BY i.id) FROM v_source_insight i WHERE i.source = s.id), '') || ']'"""
_CONFIG = "CASE substr(id, 8)::BIGINT % 5 WHEN 0 THEN 'not in' WHEN 1 THEN 'insights' WHEN 2 THEN 'full content' WHEN 3 THEN 'insights, full content' ELSE 'other' END"


def _config(t: Tables) -> DataFrame:
    key = F.substring("id", 8, 20)
    sources = t.source().select(F.lit("source").alias("type"), F.when(key.cast("long") % 2 == 0, key).otherwise(F.col("id")).alias("id"), F.expr(_CONFIG.replace("::BIGINT", "").replace("substr(id, 8)", "cast(substr(id, 8) AS long)")).alias("setting"))
    notes = t.note().select(F.lit("note").alias("type"), "id", F.when(F.col("updated") % 3 == 0, "full content").when(F.col("updated") % 3 == 1, "insights").otherwise("not in").alias("setting"))
    return sources.unionByName(notes).unionByName(t.spark.createDataFrame([("source", "absent", "insights"), ("note", "absent", "full content")], "type string, id string, setting string"))


@query(sql("source source_insight note", f""", k AS (SELECT *, {_CONFIG} AS setting FROM v_source), x AS (SELECT id, {_JSON} || CASE WHEN setting = 'full content' THEN coalesce(',"full_text":' || to_json(full_text), '') ELSE '' END || '}}' AS context FROM k s WHERE setting NOT IN ('not in', 'other')),
  y AS (SELECT id, '{{"id":"' || id || '","title":"' || title || '"' || coalesce(',"content":' || to_json(content), '') || '}}' AS context FROM v_note WHERE updated % 3 = 0)
  SELECT 'source' AS type, id, len(regexp_extract_all(context, '\\S+')) AS words, length(context) AS chars, sha256(context) AS digest FROM x UNION ALL SELECT 'note', id, len(regexp_extract_all(context, '\\S+')), length(context), sha256(context) FROM y"""))
def context_of_request(t: Tables) -> DataFrame:
    x = context.endpoint_context(_config(t), t.source(), t.source_insight(), t.note())
    return x.select("type", "id", F.regexp_count("context", F.lit(r"\S+")).cast("long").alias("words"), F.length("context").cast("long").alias("chars"), F.sha2(F.col("context").cast("binary"), 256).alias("digest"))


@query(sql("reference source source_insight note", f""", x AS (SELECT 'source' AS type, {_JSON} || '}}' AS context FROM v_source s JOIN v_reference r ON r."in" = s.id WHERE r.out = 'notebook:src1'
    UNION ALL SELECT 'note', '{{"id":"' || id || '","title":"' || title || '"' || coalesce(',"content":' || to_json(left(content, 100)), '') || '}}' FROM v_note WHERE notebook = 'notebook:src1')
  SELECT count(*) FILTER (type = 'source') AS sources, count(*) FILTER (type = 'note') AS notes, floor(sum(len(regexp_extract_all(context, '\\S+'))) * 1.3::DOUBLE)::BIGINT AS token_count, sum(length(context))::BIGINT AS char_count FROM x"""))
def context_of_notebook(t: Tables) -> DataFrame:
    x = context.endpoint_context(None, t.source(), t.source_insight(), t.note(), t.reference(), "notebook:src1")
    return context.context_totals(x)


@query(sql("source source_insight", """, i AS (SELECT source, count(*) AS n, string_agg('**Insight ID:** ' || id || chr(10) || '**Type:** ' || insight_type || chr(10) || '**Content:** ' || content || chr(10) || chr(10), '' ORDER BY id) AS listed FROM v_source_insight GROUP BY source)
  SELECT s.id, sha256('## SOURCE CONTENT' || chr(10) || '**Source ID:** ' || s.id || chr(10) || '**Title:** ' || coalesce(title, 'No title') || chr(10)
    || CASE WHEN full_text <> '' THEN '**Content:**' || chr(10) || CASE WHEN length(full_text) > 5000 THEN left(full_text, 5000) || '...' || chr(10) || '[Content truncated]' ELSE full_text END || chr(10) ELSE '' END || chr(10)
    || coalesce('## SOURCE INSIGHTS' || chr(10) || listed, '') || '## CONTEXT METADATA' || chr(10) || '- Source count: 1' || chr(10) || '- Insight count: ' || coalesce(n, 0) || chr(10) || '- Total tokens: 7' || chr(10)) AS prompt
  FROM v_source s LEFT JOIN i ON i.source = s.id"""))
def source_chat_prompts(t: Tables) -> DataFrame:
    x = context.source_prompt(t.source(), t.source_insight(), F.lit(7))
    return x.select("id", F.sha2(F.col("prompt").cast("binary"), 256).alias("prompt"))


@query(sql("source source_insight reference note", """, w AS (
    SELECT 'mixed' AS kind, s.id, 'source' AS type, 100 AS priority, title AS content FROM v_source s JOIN v_reference r ON r."in" = s.id WHERE r.out = 'notebook:src1' AND s.id IN ('source:1', 'source:2', 'source:3', 'source:5', 'source:8')
    UNION ALL SELECT 'mixed', i.id, 'insight', 75, insight_type || ': ' || content FROM v_source_insight i JOIN v_reference r ON r."in" = i.source WHERE r.out = 'notebook:src1' AND i.source IN ('source:1', 'source:2', 'source:3', 'source:5', 'source:8')
    UNION ALL SELECT 'mixed', id, 'note', 50, concat_ws(chr(10), title, content) FROM v_note WHERE notebook = 'notebook:src1' AND id IN ('note:1-0', 'note:1-1', 'note:2-0')
    UNION ALL SELECT 'source', id, 'source', 100, title FROM v_source WHERE id = 'source:4' UNION ALL SELECT 'source', id, 'insight', 75, insight_type || ': ' || content FROM v_source_insight WHERE source = 'source:4')
  SELECT kind, id, type, priority, sha256(content) AS digest, floor(len(regexp_extract_all(content, '\\S+')) * 1.3::DOUBLE)::BIGINT AS tokens FROM w"""))
def context_wrappers(t: Tables) -> DataFrame:
    mixed = context.mixed_items([f"source:{k}" for k in (1, 2, 3, 5, 8)], ["note:1-0", "note:1-1", "note:2-0"], "notebook:src1", t.reference(), t.source(), t.source_insight(), t.note())
    nothing = context.mixed_items(["source:1"], [], None, t.reference(), t.source(), t.source_insight(), t.note())
    own = context.source_items("source:4", t.source(), t.source_insight())
    tell = lambda x, kind: x.select(F.lit(kind).alias("kind"), "id", "type", "priority", F.sha2(F.col("content").cast("binary"), 256).alias("digest"), F.col("tokens").cast("long").alias("tokens"))
    return tell(mixed.unionByName(nothing), "mixed").unionByName(tell(own, "source"))


# conversations, inserts, frames and names


@query("""SELECT 'thread ' || conv_id AS thread, (row_number() OVER (PARTITION BY conv_id ORDER BY turn))::BIGINT AS n, role, sha256(text) AS digest FROM conversations""")
def conversations_appended(t: Tables) -> DataFrame:
    x = t.raw("conversations").select(F.concat(F.lit("thread "), "conv_id").alias("thread"), F.col("turn").alias("at"), "role", "text")
    none = x.limit(0).select("thread", F.lit(0).cast("long").alias("n"), "role", "text")
    log = jobs.appended(jobs.appended(none, x.where("at < 2")), x.where("at >= 2"))
    return log.select("thread", "n", "role", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))


@query(sql("notebook", "SELECT id, name, created = updated AS fresh FROM (SELECT id, name, 1 AS created, 1 AS updated FROM v_notebook UNION ALL SELECT 'notebook:added', 'added', 1, 1)"))
def record_inserted(t: Tables) -> DataFrame:
    row = t.spark.createDataFrame([("notebook:added", "added")], "id string, name string")
    table = t.notebook().select("id", "name", F.lit("2024-01-01").cast("timestamp").alias("created"), F.lit("2024-01-01").cast("timestamp").alias("updated"))
    return writes.inserted(table, row, F.lit("2024-01-02").cast("timestamp")).select("id", "name", (F.col("created") == F.col("updated")).alias("fresh"))


@query("SELECT item_id::BIGINT AS item_id, text FROM benchmark")
def frames_parsed(t: Tables) -> DataFrame:
    frames = files.event_frames(t.raw("benchmark").select("item_id", "text"))
    noise = t.spark.createDataFrame([("data: {broken\n\n",), (": a comment\n\n",)], "frame string")
    return files.parsed_frames(frames.unionByName(noise), "item_id long, text string")


@query("""SELECT 'new ' || p_partkey AS upload, CASE p_size % 3 WHEN 0 THEN p_partkey || ' (1).txt' WHEN 1 THEN 'c' || p_partkey || ' (1).x.pdf' ELSE '.f' || p_partkey || ' (3)' END AS free_name FROM part
  UNION ALL SELECT 'plain ' || p_partkey, CASE p_size % 3 WHEN 0 THEN p_partkey || ' (2).txt' WHEN 1 THEN 'c' || p_partkey || '.x (1).pdf' ELSE 'n' || p_partkey || '.txt' END FROM part""")
def upload_names(t: Tables) -> DataFrame:
    # taken: 1.txt; c1.x.pdf and 'c1.x (2).pdf'; '.f1', '.f1 (1)' and '.f1 (2)'
    part, key = t.raw("part").select("p_partkey", "p_size"), F.col("p_partkey").cast("string")
    pick = lambda *names: F.element_at(F.array(*names), (F.col("p_size") % 3 + 1).cast("int"))
    have = [
        pick(F.concat(key, F.lit(".txt")), F.concat(F.lit("c"), key, F.lit(".x.pdf")), F.concat(F.lit(".f"), key)),
        pick(F.concat(key, F.lit(" (01).txt")), F.concat(F.lit("c"), key, F.lit(".x (2).pdf")), F.concat(F.lit(".f"), key, F.lit(" (1)"))),
        pick(F.concat(key, F.lit("(1).txt")), F.concat(F.lit("c"), key, F.lit(".x (02).pdf")), F.concat(F.lit(".f"), key, F.lit(" (2)"))),
    ]
    taken = part.select(F.explode(F.array(*have)).alias("file_name"))
    # a name with a number that nobody has stays; the plain name takes the first number that is free besides it
    new = part.select(F.concat(F.lit("new "), key).alias("upload"), pick(F.concat(key, F.lit(" (1).txt")), F.concat(F.lit("c"), key, F.lit(" (1).x.pdf")), F.concat(F.lit(".f"), key)).alias("file_name"))
    plain = part.select(F.concat(F.lit("plain "), key).alias("upload"), pick(F.concat(key, F.lit(".txt")), F.concat(F.lit("c"), key, F.lit(".x.pdf")), F.concat(F.lit("n"), key, F.lit(".txt"))).alias("file_name"))
    return writes.free_names(taken, new.unionByName(plain)).select("upload", "free_name")


@query(sql("source source_embedding", """SELECT id, 'skip' AS level FROM v_source WHERE false UNION ALL SELECT id, CASE WHEN substr(id, 8)::BIGINT % 3 = 1 THEN 'short' ELSE 'full' END FROM v_source WHERE substr(id, 8)::BIGINT % 3 > 0"""))
def context_selected(t: Tables) -> DataFrame:
    key = F.substring("id", 8, 20)
    n = key.cast("long") % 3
    config = t.source().select(F.when(n == 1, key).otherwise(F.col("id")).alias("id"), F.when(n == 0, "not in").when(n == 1, "insights").otherwise("full content").alias("setting"))
    return context.selected(config, t.source().select("id", "title"), "source").select("id", "level")


@query("SELECT doc_id, [(length(coalesce(text, '')) % 7 + 0.5)::DOUBLE, (doc_id % 5)::DOUBLE] AS embedding FROM documents")
def contents_embedded(t: Tables) -> DataFrame:
    rows = t.raw("documents").select("doc_id", F.coalesce("text", F.lit("")).alias("content"), F.lit(None).cast("array<double>").alias("embedding"))
    x = models.embedded(rows, lambda texts: [[len(s) % 7 + 0.5, 0.0] for s in texts])
    return x.select("doc_id", F.array(F.get("embedding", F.lit(0)), F.get("embedding", F.lit(1)) + F.col("doc_id") % 5).alias("embedding"))


# vectors made again, and what became of them


@query(sql("source_embedding", """SELECT id, source, "order", content FROM v_source_embedding WHERE source NOT IN ('source:1', 'source:2') UNION ALL SELECT 'fresh ' || source || n, source, n, 'again' FROM (SELECT DISTINCT source FROM v_source_embedding WHERE source IN ('source:1', 'source:2')), (VALUES (0), (1), (2)) v(n)"""))
def chunks_replaced(t: Tables) -> DataFrame:
    old = t.source_embedding().select("id", "source", "order", "content")
    new = old.where("source IN ('source:1', 'source:2')").select("source").distinct().withColumn("order", F.explode(F.array(*[F.lit(n).cast("long") for n in range(3)])))
    new = new.select(F.concat(F.lit("fresh "), "source", F.col("order").cast("string")).alias("id"), "source", "order", F.lit("again").alias("content"))
    return writes.replaced(writes.replaced(old, new, "source"), new, "source")


@query(sql("source note source_insight", """SELECT type, count(*) FILTER (length(text) % 5 > 0) AS processed, count(*) FILTER (length(text) % 5 = 0) AS failed, count(*) AS total
  FROM (SELECT 'source' AS type, full_text AS text FROM v_source WHERE full_text <> '' UNION ALL SELECT 'note', content FROM v_note WHERE content <> '' UNION ALL SELECT 'insight', content FROM v_source_insight) GROUP BY type"""))
def rebuild_attempts(t: Tables) -> DataFrame:
    def embed(texts: list[str]) -> list[list[float]]:
        if any(len(x) % 5 == 0 for x in texts):
            raise ValueError("this one is refused")
        return [[float(len(x))] for x in texts]

    part = lambda df, kind, text: df.where(F.col(text) != "").select(F.lit(kind).alias("type"), F.col(text).alias("content"))
    rows = part(t.source(), "source", "full_text").unionByName(part(t.note(), "note", "content")).unionByName(part(t.source_insight(), "insight", "content"))
    return models.tally(models.attempted(rows, embed), "type")


@query(sql("model", "SELECT provider, array_to_string(list_sort(list_distinct(list(type))), ',') AS types, count(*) AS models FROM v_model WHERE provider LIKE '%A%' GROUP BY provider"))
def provider_types_available(t: Tables) -> DataFrame:
    return relational.types_by_provider(t.model(), t.model().where("provider LIKE '%A%'"))


@query(sql("note artifact source source_insight", """, i AS (SELECT 'note:' || replace(i.id, ':', '-') AS id, insight_type || ' from source ' || s.title AS title FROM v_source_insight i JOIN v_source s ON s.id = i.source WHERE insight_type = 'toxic')
  SELECT 'note' AS kind, id, title FROM v_note UNION ALL SELECT 'note', id, title FROM i UNION ALL SELECT 'edge', "in", out FROM v_artifact UNION ALL SELECT 'edge', id, 'notebook:src1' FROM i"""))
def insights_saved(t: Tables) -> DataFrame:
    found = t.source_insight().where("insight_type = 'toxic'").join(t.source().select(F.col("id").alias("source"), F.col("title").alias("source_title")), "source")
    notes, edges = writes.saved_as_notes(t.note(), t.artifact(), found.select("id", "insight_type", "source_title", "content"), "notebook:src1")
    return notes.select(F.lit("note").alias("kind"), "id", "title").unionByName(edges.select(F.lit("edge").alias("kind"), F.col("in").alias("id"), F.col("out").alias("title")))


# what is checked before it is taken in


@query("""WITH p AS (SELECT p_partkey AS id, CASE WHEN p_size % 11 = 0 THEN ' ' ELSE p_name END AS name, p_size % 25 AS n FROM part), f AS (SELECT name, min(id) AS first FROM p GROUP BY name)
  SELECT id, reason IS NULL AS valid, reason AS reject_reason FROM (SELECT p.id, CASE WHEN trim(p.name) = '' THEN 'name is required' WHEN n NOT BETWEEN 3 AND 20 THEN 'Number of segments must be between 3 and 20' WHEN p.id <> f.first THEN 'name is taken' END AS reason FROM p JOIN f USING (name))""")
def episode_profiles_checked(t: Tables) -> DataFrame:
    x = t.raw("part").selectExpr("p_partkey AS id", "CASE WHEN p_size % 11 = 0 THEN ' ' ELSE p_name END AS name", "p_size % 25 AS num_segments")
    return validation.episode_profiles(x).select("id", "valid", "reject_reason")


@query("""SELECT id, reason IS NULL AS valid, reason AS reject_reason FROM (SELECT s_suppkey AS id,
  CASE WHEN s_suppkey % 6 IN (0, 5) THEN 'Must have between 1 and 4 speakers' WHEN s_nationkey % 3 = 0 THEN 'Speaker missing required field: backstory' WHEN s_nationkey % 5 = 1 THEN 'Speaker missing required field: voice_id' END AS reason FROM supplier)""")
def speaker_profiles_checked(t: Tables) -> DataFrame:
    speaker = """map_filter(map('name', 'n', 'voice_id', 'v', 'backstory', CAST(NULL AS STRING), 'personality', ''), (k, v) -> NOT (k = 'backstory' AND s_nationkey % 3 = 0) AND NOT (k = 'voice_id' AND s_nationkey % 3 > 0 AND s_nationkey % 5 = 1))"""
    x = t.raw("supplier").selectExpr("s_suppkey AS id", "s_name AS name", f"array_repeat({speaker}, s_suppkey % 6) AS speakers".replace("s_suppkey % 6", "cast(s_suppkey % 6 AS int)"))
    return validation.speaker_profiles(x).select("id", "valid", "reject_reason")


@query("""WITH r AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'link' WHEN 1 THEN 'upload' WHEN 2 THEN 'text' ELSE 'fax' END AS type, page_id % 3 = 0 AS u, page_id % 5 = 1 AS f, page_id % 7 = 2 AS c FROM pages)
  SELECT page_id, reason IS NULL AS valid, reason AS reject_reason FROM (SELECT page_id, CASE WHEN type = 'fax' THEN 'type must be link, upload or text' WHEN type = 'link' AND NOT u THEN 'url is required for type link' WHEN type = 'upload' AND NOT f THEN 'file_path is required for type upload'
    WHEN type = 'text' AND NOT c THEN 'content is required for type text' WHEN u::INT + f::INT + c::INT > 1 THEN 'only one of url, file_path and content may be given' END AS reason FROM r)""")
def source_requests_checked(t: Tables) -> DataFrame:
    kind = "CASE page_id % 4 WHEN 0 THEN 'link' WHEN 1 THEN 'upload' WHEN 2 THEN 'text' ELSE 'fax' END AS type"
    x = t.raw("pages").selectExpr("page_id", kind, "CASE WHEN page_id % 3 = 0 THEN url END AS url", "CASE WHEN page_id % 5 = 1 THEN concat('/up/', page_id) ELSE '' END AS file_path", "CASE WHEN page_id % 7 = 2 THEN html ELSE '  ' END AS content")
    return validation.source_requests(x).select("page_id", "valid", "reject_reason")


#: Settings that a few rows of a table stand for.
_SETTINGS = ["OPENAI_API_KEY", "VERTEX_PROJECT", "VERTEX_LOCATION", "GEMINI_API_KEY", "AZURE_OPENAI_API_KEY_LLM", "AZURE_OPENAI_ENDPOINT_LLM", "AZURE_OPENAI_API_VERSION_LLM", "AZURE_OPENAI_API_KEY", "OPENAI_COMPATIBLE_BASE_URL_TTS", "OPENAI_COMPATIBLE_BASE_URL_EMBEDDING", "MISTRAL_API_KEY", "UNKNOWN"]


@query("""WITH can AS (SELECT DISTINCT CASE p_size % 4 WHEN 0 THEN 'language' WHEN 1 THEN 'embedding' WHEN 2 THEN 'text_to_speech' ELSE 'speech_to_text' END AS type, (['openai', 'azure', 'openai-compatible', 'mistral', 'google', 'vertex', 'none'])[p_partkey % 7 + 1] AS provider FROM part),
  types AS (SELECT provider, string_agg(type, ',' ORDER BY type) AS types FROM can WHERE provider IN ('openai', 'google', 'mistral') OR provider = 'azure' AND type = 'language' OR provider = 'openai-compatible' AND type IN ('text_to_speech', 'embedding') GROUP BY provider)
  SELECT p.provider, p.provider IN ('openai', 'google', 'azure', 'openai-compatible', 'mistral') AS available, coalesce(types, '') AS types
  FROM (SELECT unnest(['ollama', 'openai', 'groq', 'xai', 'vertex', 'google', 'openrouter', 'anthropic', 'elevenlabs', 'voyage', 'azure', 'mistral', 'deepseek', 'openai-compatible']) AS provider) p LEFT JOIN types USING (provider)""")
def providers_available(t: Tables) -> DataFrame:
    names = F.array(*map(F.lit, _SETTINGS))
    settings = t.raw("part").select(F.get(names, (F.col("p_partkey") % len(_SETTINGS)).cast("int")).alias("name"))
    kinds = F.array(*map(F.lit, ["language", "embedding", "text_to_speech", "speech_to_text"]))
    who = F.array(*map(F.lit, ["openai", "azure", "openai-compatible", "mistral", "google", "vertex", "none"]))
    supported = t.raw("part").select(F.get(kinds, (F.col("p_size") % 4).cast("int")).alias("type"), F.get(who, (F.col("p_partkey") % 7).cast("int")).alias("provider"))
    return providers.availability(settings, supported)


@query("""SELECT doc_id, reason IS NULL AS success, reason AS error, CASE WHEN reason IS NULL THEN 'source:' || doc_id END AS source_id, CASE WHEN reason IS NULL THEN (doc_id % 9)::INTEGER END AS chunk_index, CASE WHEN reason IS NULL THEN length(text)::DOUBLE END AS size
  FROM (SELECT *, CASE WHEN doc_id % 11 = 0 THEN 'chunk_index is required' WHEN text IS NULL THEN 'chunk_text is required' WHEN contains(text, '#') THEN 'refused: ' || length(text) END AS reason FROM documents)""")
def commands_called(t: Tables) -> DataFrame:
    """A typed command over all documents: some indexes are no numbers, some texts are refused."""

    def embed(texts: list[str]) -> list[list[float]]:
        refused = [x for x in texts if "#" in x]
        if refused:
            raise ValueError(f"refused: {len(refused[0])}")
        return [[float(len(x))] for x in texts]

    index = F.when(F.col("doc_id") % 11 == 0, "none").otherwise((F.col("doc_id") % 9).cast("string"))
    rows = t.raw("documents").select("doc_id", F.concat(F.lit("source:"), "doc_id").alias("source_id"), index.alias("chunk_index"), F.col("text").alias("chunk_text"))
    x = commands.call(commands.EMBED_CHUNK, rows, "doc_id", embed=embed)
    return x.select("doc_id", "success", "error", F.when(F.col("success"), F.col("source_id")).alias("source_id"), F.when(F.col("success"), F.col("chunk_index")).alias("chunk_index"), F.get("embedding", F.lit(0)).alias("size"))


# pages


@query("SELECT 'source:page' || page_id AS id, nullif(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '') AS title, url FROM pages")
def link_sources_markdown(t: Tables) -> DataFrame:
    """Titles and addresses as SQL has them; that the markdown is right is tested against a second parser."""
    return files.link_sources(t.raw("pages"), markdown=True).where(F.length("full_text") >= 0).select("id", "title", "url")


@query(sql("acm_record", """SELECT source_id, building_id, product || ' & ' || id AS product, '<' || material_description || '>' AS material_description, risk_status, result, 'Interior' AS area_type, 'School ' || source_id AS school_name FROM v_acm_record"""))
def register_from_pages(t: Tables) -> DataFrame:
    """A page of headings and tables for each source, read as markdown and then as a register."""
    cell = lambda c: F.concat(F.lit("<td>"), c, F.lit("</td>"))
    tell = F.concat(F.lit("<tr>"), cell(F.concat("product", F.lit(" &amp; "), "id")), cell(F.concat(F.lit("&lt;"), "material_description", F.lit("&#62;"))), cell(F.coalesce("risk_status", F.lit(""))), cell(F.col("result")), F.lit("</tr>\n"))
    rows = t.acm_record().select("source_id", "building_id", tell.alias("tr"))
    table = F.concat(F.lit("<h2>Building: "), "building_id", F.lit(" &ndash; Block</h2><table class=\"a>b\"><thead><tr><th>Product<th>Material<br>Description<th>Risk<th>Result</tr></thead><tbody>"), F.array_join(F.collect_list("tr"), ""), F.lit("</tbody></table>"))
    tables = rows.groupBy("source_id", "building_id").agg(table.alias("html"))
    page = F.concat(F.lit("<html><head><title>x</title></head><body><h1>School "), "source_id", F.lit(" &#45; Asbestos Register</h1>"), F.array_join(F.collect_list("html"), "\n"), F.lit("<p>End of it</body></html>"))
    pages = tables.groupBy("source_id").agg(page.alias("html")).select("source_id", page_markdown("html").alias("full_text"))
    return register.extract_records(pages, "source_id").select("source_id", "building_id", "product", "material_description", "risk_status", "result", "area_type", "school_name")
