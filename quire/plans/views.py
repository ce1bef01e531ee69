"""Logical tables over the parquet tables at hand, as DataFrames and as the same SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_START = 1704067200
MODEL_TYPES = ["language", "embedding", "text_to_speech", "speech_to_text"]


class Tables:
    """Logical tables of one folder; each is a plan over a scan, so unused columns are never read."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def source(self) -> DataFrame:
        return self.raw("documents").selectExpr("concat('source:', doc_id) AS id", "left(text, 40) AS title", "lang AS topic", "text AS full_text", f"{_START} + doc_id * 60 AS created", f"{_START} + (doc_id * 7919 % 100003) * 60 AS updated")

    def notebook(self) -> DataFrame:
        x = self.raw("documents").select("source").where("source IS NOT NULL").distinct()
        return x.selectExpr("concat('notebook:', source) AS id", "source AS name", "concat('about ', source) AS description", "source LIKE '%1' AS archived")

    def reference(self) -> DataFrame:
        return self.raw("documents").where("source IS NOT NULL").selectExpr("concat('source:', doc_id) AS `in`", "concat('notebook:', source) AS out")

    def source_embedding(self) -> DataFrame:
        return self.raw("embeddings").selectExpr("concat('source_embedding:', vec_id) AS id", "concat('source:', vec_id div 2) AS source", "vec_id % 2 AS `order`", "concat('label ', label, ' of the part ', vec_id % 7) AS content", "cast(embedding AS array<double>) AS embedding")

    def source_insight(self) -> DataFrame:
        vectors = self.raw("embeddings").selectExpr("vec_id", "cast(embedding AS array<double>) AS embedding")
        labels = self.raw("labels").selectExpr("doc_id", "'quality' AS insight_type", "concat('quality ', quality, ' of the text') AS content").unionByName(self.raw("labels").selectExpr("doc_id", "'toxic' AS insight_type", "concat('toxic ', toxic) AS content"))
        x = labels.join(vectors, F.col("doc_id") == F.col("vec_id"), "left")
        return x.selectExpr("concat('source_insight:', doc_id, insight_type) AS id", "concat('source:', doc_id) AS source", "insight_type", "content", "embedding")

    def note(self) -> DataFrame:
        vectors = self.raw("embeddings").selectExpr("vec_id", "cast(embedding AS array<double>) AS embedding")
        x = self.raw("conversations").where("role IN ('assistant', 'user')").join(vectors, F.col("conv_id") == F.col("vec_id"), "left")
        return x.selectExpr("concat('note:', conv_id, '-', turn) AS id", "concat('turn ', turn, ' of the talk') AS title", "text AS content", "CASE role WHEN 'assistant' THEN 'ai' ELSE 'human' END AS note_type", "concat('notebook:src', conv_id % 5) AS notebook", f"{_START} + conv_id * 60 + turn AS updated", "embedding")

    def chat_session(self) -> DataFrame:
        return self.raw("conversations").select("conv_id").distinct().selectExpr("concat('chat_session:', conv_id) AS id", "concat('conversation ', conv_id) AS title", f"{_START} + conv_id * 60 AS created", f"{_START} + conv_id * 61 AS updated")

    def refers_to(self) -> DataFrame:
        return self.raw("conversations").select("conv_id").distinct().selectExpr("concat('chat_session:', conv_id) AS `in`", "concat('source:', conv_id % 50) AS out")

    def model(self) -> DataFrame:
        types = ", ".join(f"'{t}'" for t in MODEL_TYPES)
        return self.raw("part").selectExpr("concat('model:', p_partkey) AS id", "p_brand AS name", "p_type AS provider", f"element_at(array({types}), p_size % 4 + 1) AS type")

    def acm_record(self) -> DataFrame:
        lines, parts = self.raw("lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_returnflag"), self.raw("part").select("p_partkey", "p_name", "p_type")
        orders = self.raw("orders").select("o_orderkey", "o_orderpriority")
        x = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        return x.selectExpr(
            "concat('acm_record:', l_orderkey, '-', l_linenumber) AS id", "concat('source:', l_orderkey) AS source_id", "'School' AS school_name", "concat('B', l_suppkey) AS building_id",
            "CASE WHEN l_partkey % 5 = 0 THEN NULL WHEN l_partkey % 7 = 0 THEN '' ELSE concat('R', l_partkey) END AS room_id", "p_name AS product", "p_type AS material_description", "l_returnflag AS result",
            "CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'High' WHEN o_orderpriority = '3-MEDIUM' THEN 'Medium' WHEN o_orderpriority = '5-LOW' THEN 'Low' END AS risk_status", "CASE l_linenumber WHEN 1 THEN 0 WHEN 2 THEN NULL ELSE l_linenumber END AS page_number",
        )

    def artifact(self) -> DataFrame:
        return self.raw("conversations").where("role IN ('assistant', 'user')").selectExpr("concat('note:', conv_id, '-', turn) AS `in`", "concat('notebook:src', conv_id % 5) AS out")

    def episode_profile(self) -> DataFrame:
        return self.raw("part").selectExpr("concat('episode_profile:', p_partkey) AS id", "concat('episode ', p_partkey) AS name", "concat('speaker ', p_partkey % 12) AS speaker_config", "p_name AS default_briefing", "CASE p_size % 3 WHEN 0 THEN p_type WHEN 1 THEN '' END AS suffix")

    def speaker_profile(self) -> DataFrame:
        return self.raw("supplier").selectExpr("concat('speaker_profile:', s_suppkey) AS id", "concat('speaker ', s_suppkey) AS name", "s_name AS speakers")

    def episode(self) -> DataFrame:
        return self.raw("part").selectExpr("concat('episode:', p_partkey) AS id", "CASE p_size % 3 WHEN 0 THEN concat('command:', p_partkey) WHEN 1 THEN '' END AS command", "CASE WHEN p_partkey % 2 = 0 THEN concat('/audio/', p_partkey) END AS audio_file")

    def job(self) -> DataFrame:
        states = "CASE event_type WHEN 'view' THEN 'new' WHEN 'click' THEN 'queued' WHEN 'signup' THEN 'running' WHEN 'purchase' THEN 'completed' ELSE 'failed' END"
        return self.raw("events").selectExpr("concat('command:', user_id) AS job_id", "event_id", "ts", f"{states} AS status", "value")


#: The same tables for DuckDB.
SQL = {
    "source": f"SELECT 'source:' || doc_id AS id, left(text, 40) AS title, lang AS topic, text AS full_text, {_START} + doc_id * 60 AS created, {_START} + (doc_id * 7919 % 100003) * 60 AS updated FROM documents",
    "notebook": "SELECT DISTINCT 'notebook:' || source AS id, source AS name, 'about ' || source AS description, source LIKE '%1' AS archived FROM documents WHERE source IS NOT NULL",
    "reference": """SELECT 'source:' || doc_id AS "in", 'notebook:' || source AS out FROM documents WHERE source IS NOT NULL""",
    "source_embedding": """SELECT 'source_embedding:' || vec_id AS id, 'source:' || (vec_id // 2) AS source, vec_id % 2 AS "order", 'label ' || label || ' of the part ' || (vec_id % 7) AS content, embedding::DOUBLE[] AS embedding FROM embeddings""",
    "source_insight": """SELECT 'source_insight:' || doc_id || insight_type AS id, 'source:' || doc_id AS source, insight_type, content, embedding::DOUBLE[] AS embedding
      FROM (SELECT doc_id, 'quality' AS insight_type, 'quality ' || quality || ' of the text' AS content FROM labels UNION ALL SELECT doc_id, 'toxic', 'toxic ' || toxic FROM labels) l LEFT JOIN embeddings ON doc_id = vec_id""",
    "note": f"""SELECT 'note:' || conv_id || '-' || turn AS id, 'turn ' || turn || ' of the talk' AS title, text AS content, CASE role WHEN 'assistant' THEN 'ai' ELSE 'human' END AS note_type, 'notebook:src' || (conv_id % 5) AS notebook,
      {_START} + conv_id * 60 + turn AS updated, embedding::DOUBLE[] AS embedding FROM conversations LEFT JOIN embeddings ON conv_id = vec_id WHERE role IN ('assistant', 'user')""",
    "chat_session": f"SELECT DISTINCT 'chat_session:' || conv_id AS id, 'conversation ' || conv_id AS title, {_START} + conv_id * 60 AS created, {_START} + conv_id * 61 AS updated FROM conversations",
    "refers_to": """SELECT DISTINCT 'chat_session:' || conv_id AS "in", 'source:' || (conv_id % 50) AS out FROM conversations""",
    "model": f"SELECT 'model:' || p_partkey AS id, p_brand AS name, p_type AS provider, ({MODEL_TYPES!r})[p_size % 4 + 1] AS type FROM part",
    "acm_record": """SELECT 'acm_record:' || l_orderkey || '-' || l_linenumber AS id, 'source:' || l_orderkey AS source_id, 'School' AS school_name, 'B' || l_suppkey AS building_id,
      CASE WHEN l_partkey % 5 = 0 THEN NULL WHEN l_partkey % 7 = 0 THEN '' ELSE 'R' || l_partkey END AS room_id, p_name AS product, p_type AS material_description, l_returnflag AS result,
      CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'High' WHEN o_orderpriority = '3-MEDIUM' THEN 'Medium' WHEN o_orderpriority = '5-LOW' THEN 'Low' END AS risk_status, CASE l_linenumber WHEN 1 THEN 0 WHEN 2 THEN NULL ELSE l_linenumber END AS page_number
      FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey""",
    "artifact": """SELECT 'note:' || conv_id || '-' || turn AS "in", 'notebook:src' || (conv_id % 5) AS out FROM conversations WHERE role IN ('assistant', 'user')""",
    "episode_profile": "SELECT 'episode_profile:' || p_partkey AS id, 'episode ' || p_partkey AS name, 'speaker ' || (p_partkey % 12) AS speaker_config, p_name AS default_briefing, CASE p_size % 3 WHEN 0 THEN p_type WHEN 1 THEN '' END AS suffix FROM part",
    "speaker_profile": "SELECT 'speaker_profile:' || s_suppkey AS id, 'speaker ' || s_suppkey AS name, s_name AS speakers FROM supplier",
    "episode": "SELECT 'episode:' || p_partkey AS id, CASE p_size % 3 WHEN 0 THEN 'command:' || p_partkey WHEN 1 THEN '' END AS command, CASE WHEN p_partkey % 2 = 0 THEN '/audio/' || p_partkey END AS audio_file FROM part",
    "job": "SELECT 'command:' || user_id AS job_id, event_id, ts, CASE event_type WHEN 'view' THEN 'new' WHEN 'click' THEN 'queued' WHEN 'signup' THEN 'running' WHEN 'purchase' THEN 'completed' ELSE 'failed' END AS status, value FROM events",
}


def sql(tables: str, body: str) -> str:
    """body over the named logical tables."""
    return "WITH " + ", ".join(f"v_{t} AS ({SQL[t]})" for t in tables.split()) + " " + body
