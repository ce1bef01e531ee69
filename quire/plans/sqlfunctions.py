"""Searches as table functions of SQL: SELECT ... FROM text_search('x', 10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stem import stem
from ..operators import postings
from ..operators.search import TOKEN, B, K1


def register_text_search(spark: SparkSession, folder: str, name: str = "text_search") -> None:
    """Makes `name`(query, k) a temporary function over a postings index: id, parent_id, title, relevance of the k best.

    The query may be any expression; its terms, a few, find their buckets by a join, so that only those folders are read and
    only those terms' blocks are opened."""
    index = postings.Index(spark, folder)
    index.table("gone").select("segment", "doc").createOrReplaceTempView(f"{name}_gone")
    docs = index.alive()
    docs.createOrReplaceTempView(f"{name}_docs")
    index.table("postings").createOrReplaceTempView(f"{name}_blocks")
    docs.groupBy("field").agg(F.count("*").alias("docs"), F.avg("words").alias("mean")).createOrReplaceTempView(f"{name}_fields")
    spark.udf.register(f"{name}_stem", stem if index.stemmed else lambda w: w, "string")
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION {name}(query STRING, k INT) RETURNS TABLE (id STRING, parent_id STRING, title STRING, relevance DOUBLE) RETURN
      WITH words AS (SELECT explode(regexp_extract_all(query, r'{TOKEN}', 0)) AS word),
      asked AS (SELECT DISTINCT {name}_stem(lower(word)) AS term FROM words),
      blocks AS (SELECT /*+ BROADCAST(a) */ b.* FROM {name}_blocks b JOIN (SELECT term, CAST(crc32(term) % {max(index.buckets, 1)} AS INT) AS bucket FROM asked) a ON b.bucket = a.bucket AND b.term = a.term),
      entries AS (SELECT segment, field, term, block * {postings.BLOCK} + e.offsets AS doc, e.counts AS count, e.lengths AS words FROM (SELECT *, explode(arrays_zip(offsets, counts, lengths)) AS e FROM blocks)),
      hits AS (SELECT e.* FROM entries e LEFT ANTI JOIN {name}_gone g ON e.segment = g.segment AND e.doc = g.doc),
      held AS (SELECT field, term, count(*) AS df FROM hits GROUP BY field, term),
      parts AS (SELECT h.segment, h.doc, ln(1 + (f.docs - t.df + 0.5D) / (t.df + 0.5D)) * h.count * {K1 + 1}D / (h.count + {K1}D * ({1 - B}D + {B}D * h.words / f.mean)) AS part
        FROM hits h JOIN held t ON h.field = t.field AND h.term = t.term JOIN {name}_fields f ON f.field = h.field),
      whole AS (SELECT segment, doc, sum(part) AS relevance FROM parts GROUP BY segment, doc HAVING count(*) = (SELECT count(*) FROM asked)),
      found AS (SELECT d.parent AS id, d.title, max(relevance) AS relevance FROM whole w JOIN {name}_docs d ON w.segment = d.segment AND w.doc = d.doc WHERE d.parent IS NOT NULL GROUP BY d.parent, d.title),
      ranked AS (SELECT *, row_number() OVER (ORDER BY relevance DESC, id) AS place FROM found)
      SELECT id, id AS parent_id, title, relevance FROM ranked WHERE place <= k""")


def register_vector_search(spark: SparkSession, source: DataFrame, embedding: DataFrame, insight: DataFrame, note: DataFrame, name: str = "vector_search") -> None:
    """Makes `name`(vector, k, least) a temporary function: id, parent_id, title, similarity, matches, as vector_search() has them."""
    for table, df in (("source", source), ("embedding", embedding), ("insight", insight), ("note", note)):
        df.createOrReplaceTempView(f"{name}_{table}")
    dot = lambda a, b: f"aggregate(zip_with({a}, {b}, (x, y) -> x * y), 0D, (s, x) -> s + x)"
    near = f"{dot('embedding', 'vector')} / nullif(sqrt({dot('embedding', 'embedding')}) * sqrt({dot('vector', 'vector')}), 0)"

    def branch(table: str, columns: str) -> str:
        return f"""(SELECT * FROM (SELECT *, row_number() OVER (ORDER BY similarity DESC, id) AS place FROM (SELECT {columns}, {near} AS similarity FROM {name}_{table} WHERE size(embedding) = size(vector)) WHERE similarity >= least) WHERE place <= k)"""

    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION {name}(vector ARRAY<DOUBLE>, k INT, least DOUBLE) RETURNS TABLE (id STRING, parent_id STRING, title STRING, similarity DOUBLE, matches ARRAY<STRING>) RETURN
      WITH found AS (
        SELECT b.source AS id, b.source AS parent_id, s.title, b.content, b.similarity FROM {branch('embedding', 'id, source, content')} b LEFT JOIN {name}_source s ON s.id = b.source
        UNION SELECT b.id, b.source, concat(b.insight_type, ' - ', coalesce(s.title, '')), b.content, b.similarity FROM {branch('insight', 'id, source, insight_type, content')} b LEFT JOIN {name}_source s ON s.id = b.source
        UNION SELECT b.id, b.id, b.title, b.content, b.similarity FROM {branch('note', 'id, title, content')} b),
      grouped AS (SELECT id, parent_id, title, max(similarity) AS similarity, transform(sort_array(collect_list(named_struct('s', -similarity, 'c', content))), m -> m.c) AS matches FROM found WHERE id IS NOT NULL GROUP BY id, parent_id, title),
      ranked AS (SELECT *, row_number() OVER (ORDER BY similarity DESC, id) AS place FROM grouped)
      SELECT id, parent_id, title, similarity, matches FROM ranked WHERE place <= k""")
