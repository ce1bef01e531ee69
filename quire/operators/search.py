"""BM25 text search and cosine vector search with grouped top-k results.

Queries are a few terms or one vector: they are literals of the plan. Texts are tokenised once and counted in place: one
scan writes narrow rows of counts, from which statistics and scores are taken; only the k best rows of each branch move.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stem import stem, stems
from .durable import checkpointed

K1, B = 1.2, 0.75


#: A number, or letters up to where a capital follows a small letter.
TOKEN = r"\p{N}++|\p{L}[a-z[\p{L}&&[^\p{Lu}]]]*+(?:(?<!\p{Ll})\p{Lu}[a-z[\p{L}&&[^\p{Lu}]]]*+)*+"


def tokens(text: Column) -> Column:
    """Words and numbers in lower case; a change from lower to upper case or between letters and digits parts them."""
    return F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), F.lower)


def query_terms(query: str) -> list[str]:
    """The distinct terms of a query, as tokens() has them."""
    x = "".join(f" {c}" if i and (query[i - 1].islower() and c.isupper() or query[i - 1].isalpha() and c.isnumeric() or query[i - 1].isnumeric() and c.isalpha()) else c for i, c in enumerate(query))
    terms = list(dict.fromkeys(re.findall(r"[^\W_]+", x.lower())))
    if not terms:
        raise ValueError("the query has no words")
    return terms


def _equals(term: str):
    return lambda t: t == F.lit(term)


def _among(forms: str):
    return lambda t: F.array_contains(forms, t)


def begins(stemmed: str) -> str:
    """What every word with this stem begins with: the rules change the last three letters of a stem at most, and no first one."""
    return stemmed[: max(1, len(stemmed) - 3)]


def may_hold(text: Column, beginnings: list[str]) -> Column:
    """Whether a text can have a word that begins with one of these; true where that takes its words to tell. Null for null."""
    if not all(b.isascii() for b in beginnings):
        return text.isNotNull()
    return reduce(lambda a, b: a | b, [F.contains(F.lower(text), F.lit(b)) for b in beginnings])


def word_forms(docs: DataFrame, texts: list[str], stemmed: list[str]) -> DataFrame:
    """One row: arrays __form0, __form1, ... of the distinct words with each stem.

    Only texts that may hold such words are read for them, and each distinct word that begins like a stem is stemmed once. The
    rules take finitely many suffixes off, so only so many words share a stem."""
    start = [begins(s) for s in stemmed]
    alike = lambda w: reduce(lambda a, b: a | b, [F.startswith(w, F.lit(b)) for b in start])
    each = reduce(DataFrame.unionByName, [docs.where(may_hold(F.col(t), start)).select(F.explode(F.array_distinct(F.filter(tokens(F.col(t)), alike))).alias("__w")) for t in texts])
    vocabulary = each.distinct().withColumn("__s", stems("__w"))
    return vocabulary.where(F.col("__s").isin(stemmed)).agg(*[F.collect_set(F.when(F.col("__s") == s, F.col("__w"))).alias(f"__form{i}") for i, s in enumerate(stemmed)])


def _counted(docs: DataFrame, texts: list[str], query: str, stemmed: bool, keep: list[str]) -> tuple[DataFrame, int]:
    """keep, and for each text the number of its words (null for null) and how often it holds each term; and how many terms.

    Texts are tokenised here, once, for statistics and scores alike: the counts are written out, narrow rows of numbers."""
    terms = query_terms(query)
    x = docs.select(*keep, *[tokens(F.col(t)).alias(f"__t{j}") for j, t in enumerate(texts)])
    if stemmed:
        terms = list(dict.fromkeys(map(stem, terms)))
        x = x.join(F.broadcast(word_forms(docs, texts, terms)))  # one row
    count = lambda j, i: F.size(F.filter(f"__t{j}", _among(f"__form{i}") if stemmed else _equals(terms[i])))
    numbers = [c for j in range(len(texts)) for c in (F.when(F.col(f"__t{j}").isNotNull(), F.size(f"__t{j}")).alias(f"__dl{j}"), *[count(j, i).alias(f"__tf{j}_{i}") for i in range(len(terms))])]
    return checkpointed(x.select(*keep, *numbers)), len(terms)


def _scored(counted: DataFrame, j: int, terms: int, keep: list[str]) -> DataFrame:
    """keep and relevance, for the rows whose j-th text holds all terms; statistics are those of all rows with such a text."""
    x = counted.where(F.col(f"__dl{j}").isNotNull()).select(*keep, F.col(f"__dl{j}").alias("__dl"), *[F.col(f"__tf{j}_{i}").alias(f"__tf{i}") for i in range(terms)])
    stats = x.agg(F.count("*").alias("__n"), F.avg("__dl").alias("__avg"), *[F.count_if(F.col(f"__tf{i}") > 0).alias(f"__df{i}") for i in range(terms)])
    x = x.where(reduce(lambda a, b: a & b, [F.col(f"__tf{i}") > 0 for i in range(terms)])).join(F.broadcast(stats))  # one row
    n, norm = F.col("__n"), K1 * (1 - B + B * F.col("__dl") / F.col("__avg"))
    score = [F.ln(1 + (n - F.col(f"__df{i}") + 0.5) / (F.col(f"__df{i}") + 0.5)) * F.col(f"__tf{i}") * (K1 + 1) / (F.col(f"__tf{i}") + norm) for i in range(terms)]
    return x.select(*keep, reduce(lambda a, b: a + b, score).alias("relevance"))


def bm25(docs: DataFrame, text: str, query: str, stemmed: bool = False, keep: list[str] | None = None) -> DataFrame:
    """The columns keep (all, if None) with `relevance`, for rows that hold all terms.

    With `stemmed`, a term stands for all words with its English stem."""
    keep = docs.columns if keep is None else keep
    counted, terms = _counted(docs, [text], query, stemmed, keep)
    return _scored(counted, 0, terms, keep)


def highlight(docs: DataFrame, text: str, query: str, stemmed: bool = True) -> DataFrame:
    """Adds `highlight`: the text with the words that the query finds between backticks, all else as it is; null for null.

    Words are those of the search, by the same rules: a text is parted into its words and what lies between them, words that
    a term stands for are marked, and the parts are put together again. A text that can't hold such a word stays as it is."""
    terms = query_terms(query)
    parts = F.regexp_extract_all(text, F.lit(rf"{TOKEN}|[^\p{{L}}\p{{N}}]+"), F.lit(0))
    if not stemmed:
        forms = F.array(*map(F.lit, terms))
        return docs.withColumn("highlight", F.when(may_hold(F.col(text), terms), _marked(parts, forms)).otherwise(F.col(text)))
    stemmed_terms = list(dict.fromkeys(map(stem, terms)))
    found = word_forms(docs, [text], stemmed_terms)
    forms = found.select(F.concat(*[F.coalesce(c, F.array().cast("array<string>")) for c in found.columns]).alias("__forms"))
    marked = F.when(may_hold(F.col(text), [begins(s) for s in stemmed_terms]), _marked(parts, F.col("__forms"))).otherwise(F.col(text))
    return docs.join(F.broadcast(forms)).withColumn("highlight", marked).drop("__forms")  # one row


def _marked(parts: Column, forms: Column) -> Column:
    return F.array_join(F.transform(parts, lambda p: F.when(F.array_contains(forms, F.lower(p)), F.concat(F.lit("`"), p, F.lit("`"))).otherwise(p)), "")


def text_branches(query: str, source: DataFrame, embedding: DataFrame, insight: DataFrame, note: DataFrame, sources: bool = True, notes: bool = True, stemmed: bool = True) -> dict[str, DataFrame]:
    """id, parent_id, title, relevance of each of the six texts that are searched, statistics of their own.

    An insight is its own parent here, as in the behaviour that is rebuilt. Titles are joined to the rows that are found."""
    titles = source.select(F.col("id").alias("source"), F.col("title").alias("source_title"))
    pick = lambda df, id, parent, title: df.groupBy(F.col(id).alias("id"), F.col(parent).alias("parent_id"), title.alias("title")).agg(F.max("relevance").alias("relevance"))
    out = {}
    if sources:
        counted, n = _counted(source.select("id", "title", "full_text"), ["title", "full_text"], query, stemmed, ["id", "title"])
        chunks, k = _counted(embedding.select("source", "content"), ["content"], query, stemmed, ["source"])
        insights, m = _counted(insight.select("id", "source", "insight_type", "content"), ["content"], query, stemmed, ["id", "source", "insight_type"])
        out["source title"] = pick(_scored(counted, 0, n, ["id", "title"]), "id", "id", F.col("title"))
        out["chunk"] = pick(_scored(chunks, 0, k, ["source"]).join(titles, "source", "left"), "source", "source", F.col("source_title"))
        out["source text"] = pick(_scored(counted, 1, n, ["id", "title"]), "id", "id", F.col("title"))
        out["insight"] = pick(_scored(insights, 0, m, ["id", "source", "insight_type"]).join(titles, "source", "left"), "id", "id", insight_title())
    if notes:
        counted, n = _counted(note.select("id", "title", "content"), ["title", "content"], query, stemmed, ["id", "title"])
        for j, name in enumerate(("note title", "note text")):
            out[name] = pick(_scored(counted, j, n, ["id", "title"]), "id", "id", F.col("title"))
    return out


def text_search(query: str, k: int, source: DataFrame, embedding: DataFrame, insight: DataFrame, note: DataFrame, sources: bool = True, notes: bool = True, stemmed: bool = True) -> DataFrame:
    """id, parent_id, title, relevance: the best score of each id over the six branches, the k best."""
    return _best(list(text_branches(query, source, embedding, insight, note, sources, notes, stemmed).values()), "relevance", k)


def insight_title() -> Column:
    return F.concat(F.col("insight_type"), F.lit(" - "), F.coalesce("source_title", F.lit("")))


def _best(parts: list[DataFrame], score: str, k: int, **more: Column) -> DataFrame:
    """Set union of the branches, best score of each id, k best in all (ties by id)."""
    if not parts:
        raise ValueError("search in sources, notes or both")
    union = reduce(DataFrame.unionByName, parts).distinct().where(F.col("id").isNotNull())
    return union.groupBy("id", "parent_id", "title").agg(F.max(score).alias(score), *[c.alias(n) for n, c in more.items()]).orderBy(F.col(score).desc(), "id").limit(k)


def cosine(v: Column, q: list[float]) -> Column:
    """In double precision, inside code generation; a zero vector gives null."""
    query = F.array(*[F.lit(float(x)) for x in q])
    dot = F.aggregate(F.zip_with(v, query, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    size = sum(float(x) * float(x) for x in q) ** 0.5
    return F.when((norm > 0) & F.lit(size > 0), dot / (norm * F.lit(size)))


def near(df: DataFrame, vector: str, q: list[float], least: float) -> DataFrame:
    """Rows whose vector has the query's length and is at least `least` similar; adds similarity."""
    return df.where(F.size(vector) == len(q)).withColumn("similarity", cosine(F.col(vector), q)).where(F.col("similarity") >= least)


def vector_search(q: list[float], k: int, source: DataFrame, embedding: DataFrame, insight: DataFrame, note: DataFrame, sources: bool = True, notes: bool = True, least: float = 0.2) -> DataFrame:
    """id, parent_id, title, similarity, matches. Each branch keeps its k best before rows are grouped, so many near
    chunks of one source can crowd others out."""
    titles = source.select(F.col("id").alias("source"), F.col("title").alias("source_title"))
    top = lambda df, *cols: df.select(*cols, "content", "similarity").orderBy(F.col("similarity").desc(), "row_id").limit(k).drop("row_id")
    parts = []
    if sources:
        chunks = near(embedding.withColumnRenamed("id", "row_id"), "embedding", q, least)
        parts.append(top(chunks, "row_id", "source").join(titles, "source", "left").select(F.col("source").alias("id"), F.col("source").alias("parent_id"), F.col("source_title").alias("title"), "content", "similarity"))
        found = near(insight.withColumnRenamed("id", "row_id"), "embedding", q, least).withColumn("id", F.col("row_id"))
        parts.append(top(found, "row_id", "id", "source", "insight_type").join(titles, "source", "left").select("id", F.col("source").alias("parent_id"), insight_title().alias("title"), "content", "similarity"))
    if notes:
        found = near(note.withColumnRenamed("id", "row_id"), "embedding", q, least).withColumn("id", F.col("row_id"))
        parts.append(top(found, "row_id", "id", "title").select("id", F.col("id").alias("parent_id"), "title", "content", "similarity"))
    matches = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("similarity")).alias("s"), "content"))), lambda m: m["content"])
    return _best(parts, "similarity", k, matches=matches)


def batch_search(queries: list[tuple[str, list[float]]], embedding: DataFrame, k: int = 10, least: float = 0.2) -> DataFrame:
    """query, rank, id, similarity of each query's k best chunks, from one scan for all queries."""
    each = F.array(*[F.struct(F.lit(name).alias("query"), F.when(F.size("embedding") == len(q), cosine(F.col("embedding"), q)).alias("similarity")) for name, q in queries])
    x = embedding.select("id", F.explode(each).alias("m")).select("id", "m.*").where(F.col("similarity") >= least)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("similarity").desc(), "id"))
    return x.withColumn("rank", rank).where(F.col("rank") <= k).select("query", "rank", "id", "similarity")


def resorted(results: DataFrame) -> DataFrame:
    """Adds final_score, the first of relevance, similarity and score that is there (0 for none), best first."""
    scores = [F.col(c).cast("double") for c in ("relevance", "similarity", "score") if c in results.columns]
    return results.withColumn("final_score", F.coalesce(*scores, F.lit(0.0))).orderBy(F.col("final_score").desc(), "id")
