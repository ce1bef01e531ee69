"""Answering questions over the sources: a strategy of searches, an answer from each search's results, and one answer of all.

The model calls are functions that the user gives; they run inside tasks on slices of Arrow batches and get JSON texts:

    plan(questions) -> JSON texts with reasoning and searches (term, instructions)
    embed(terms) -> vectors
    answer(payloads) -> texts; a payload holds question, term, instructions, ids and results (id, title, similarity, matches)
    conclude(payloads) -> texts; a payload holds question, reasoning, searches (term, instructions, ids) and answers

Searches without results give no answer, as there is nothing to ask about. What models think aloud is cut out. Questions are
known by question_id, given once; a question whose plan has no searches is concluded without answers. Null questions are left
out. A question's searches are few, so are its answers; questions may be any number."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .chunks import slices
from .durable import checkpointed
from .models import WAIT, _tried, embedded
from .vectors import search_of_many

Answer = Callable[[list[str]], list[str]]


def _asked(rows: DataFrame, call: Answer, keep: list[str], retries: int = 5, wait: tuple[float, float] = WAIT) -> DataFrame:
    """keep, and `said`: the call's answer to the column payload without what it thinks aloud."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (s for batch in batches for s in slices(batch, "payload")):
            payloads = b.column("payload").to_pylist()
            said = _tried(call, payloads, retries, wait) if payloads else []
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(said, pa.string())], [*keep, "said"])

    x = rows.select(*keep, "payload")
    fields = ", ".join(f"`{c}` {x.schema[c].dataType.simpleString()}" for c in keep)
    return x.mapInArrow(run, f"{fields}, said string").withColumn("said", T.without_thinking(F.col("said")))


def strategies(questions: DataFrame, plan: Answer, **tries) -> DataFrame:
    """question_id, question, reasoning, n (from 0; null for no search), term, instructions: a row for each search of each
    plan. A plan that is no JSON is an error."""
    x = questions.where(F.col("question").isNotNull()).select("question_id", "question", F.col("question").alias("payload"))
    said = _asked(x, plan, ["question_id", "question"], **tries)
    parsed = F.from_json("said", "reasoning string, searches array<struct<term:string,instructions:string>>", {"mode": "FAILFAST"})
    planned = said.select("question_id", "question", parsed.alias("plan"))
    return planned.select("question_id", "question", "plan.reasoning", F.posexplode_outer("plan.searches").alias("n", "s")).select("question_id", "question", "reasoning", "n", "s.term", "s.instructions")


def retrieved(strategy: DataFrame, embed: Callable[[list[str]], list[list[float]]], source: DataFrame, embedding: DataFrame, insight: DataFrame, note: DataFrame, k: int = 10, least: float = 0.2, **tries) -> DataFrame:
    """term, results: for each distinct term that finds something, its k best (id, title, similarity, matches), best first."""
    terms = checkpointed(embedded(strategy.where(F.col("term").isNotNull()).select("term").distinct(), embed, "term", **tries))
    queries = terms.select(F.col("term").alias("query"), F.col("embedding").alias("vector"))
    hits = search_of_many(queries, k, source, embedding, insight, note, least)
    item = F.struct((-F.col("similarity")).alias("s"), "id", "title", "similarity", "matches")
    best = F.transform(F.array_sort(F.collect_list(item)), lambda r: F.struct(r["id"].alias("id"), r["title"].alias("title"), r["similarity"].alias("similarity"), r["matches"].alias("matches")))
    return hits.groupBy(F.col("query").alias("term")).agg(best.alias("results"))  # at most k


def ask(questions: DataFrame, plan: Answer, embed: Callable[[list[str]], list[list[float]]], answer: Answer, conclude: Answer, source: DataFrame, embedding: DataFrame, insight: DataFrame, note: DataFrame, k: int = 10, least: float = 0.2, retries: int = 5, wait: tuple[float, float] = WAIT) -> DataFrame:
    """question_id, question, reasoning, searches (term, instructions, ids), answers (in order of the searches), final_answer."""
    tries = {"retries": retries, "wait": wait}
    # models are not asked twice where a later step is run again
    strategy = checkpointed(strategies(questions, plan, **tries))
    found = checkpointed(retrieved(strategy, embed, source, embedding, insight, note, k, least, **tries))
    each = strategy.join(found, "term", "left").withColumn("ids", F.transform("results", lambda r: r["id"]))
    payload = F.to_json(F.struct("question", "term", "instructions", "ids", "results"))
    answers = _asked(each.where(F.col("results").isNotNull()).withColumn("payload", payload), answer, ["question_id", "n"], **tries)
    answers = checkpointed(answers.select("question_id", "n", F.col("said").alias("answer")))
    x = each.join(answers, ["question_id", "n"], "left")
    search = F.when(F.col("n").isNotNull(), F.struct("n", "term", "instructions", F.coalesce("ids", F.array().cast("array<string>")).alias("ids"), "answer"))
    x = x.groupBy("question_id", "question", "reasoning").agg(F.array_sort(F.collect_list(search)).alias("s"))  # few searches
    searches = F.transform("s", lambda s: F.struct(s["term"].alias("term"), s["instructions"].alias("instructions"), s["ids"].alias("ids")))
    given = F.filter(F.transform("s", lambda s: s["answer"]), lambda a: a.isNotNull())
    x = x.select("question_id", "question", "reasoning", searches.alias("searches"), given.alias("answers"))
    x = checkpointed(x.withColumn("payload", F.to_json(F.struct("question", "reasoning", "searches", "answers"))))
    final = _asked(x, conclude, ["question_id"], **tries).select("question_id", F.col("said").alias("final_answer"))
    return x.drop("payload").join(final, "question_id")

