"""Operators that call a model: the call is a function that the user gives, run inside tasks on slices of Arrow batches, about a
megabyte of text or one row each, so that a task holds no batch as Python texts."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import slices

#: Seconds between tries: from the first to the longest, doubled each time, with up to the first added by chance.
WAIT = (1.0, 30.0)


def embedded(rows: DataFrame, embed: Callable[[list[str]], list[list[float]]], text_col: str = "content", retries: int = 5, wait: tuple[float, float] = WAIT) -> DataFrame:
    """Adds `embedding` (empty for null texts). A slice is asked again up to `retries` times if the call fails."""
    x = rows.drop("embedding")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (s for batch in batches for s in slices(batch, text_col)):
            texts = b.column(text_col).to_pylist()
            asked = [t for t in texts if t is not None]
            got = iter(_tried(embed, asked, retries, wait) if asked else [])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([[] if t is None else list(next(got)) for t in texts], pa.list_(pa.float64()))], [*b.schema.names, "embedding"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in x.schema.fields)
    return x.mapInArrow(run, f"{fields}, embedding array<double>")


def _tried(call, argument, retries: int, wait: tuple[float, float] = WAIT):
    for n in range(retries):
        try:
            return call(argument)
        except (RuntimeError, ConnectionError, TimeoutError):
            if n == retries - 1:
                raise
            time.sleep(min(wait[1], wait[0] * 2**n + random.uniform(0, wait[0])))


def attempted(rows: DataFrame, embed: Callable[[list[str]], list[list[float]]], text_col: str = "content", retries: int = 1, wait: tuple[float, float] = WAIT) -> DataFrame:
    """Adds `embedding` and `error`: a slice that fails is tried row by row, and a row that fails says why (embedding null).

    Null texts have an empty embedding and no error."""
    x = rows.drop("embedding", "error")

    def one(text: str | None) -> tuple[list[float] | None, str | None]:
        if text is None:
            return [], None
        try:
            return list(_tried(embed, [text], retries, wait)[0]), None
        except Exception as e:  # noqa: BLE001  whatever the call raises is this row's error
            return None, str(e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (s for batch in batches for s in slices(batch, text_col)):
            texts = b.column(text_col).to_pylist()
            asked = [t for t in texts if t is not None]
            try:
                made = iter(_tried(embed, asked, retries, wait) if asked else [])
                got = [([], None) if t is None else (list(next(made)), None) for t in texts]
            except Exception:  # noqa: BLE001
                got = [one(t) for t in texts]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([v for v, _ in got], pa.list_(pa.float64())), pa.array([e for _, e in got], pa.string())], [*b.schema.names, "embedding", "error"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in x.schema.fields)
    return x.mapInArrow(run, f"{fields}, embedding array<double>, error string")


def tally(attempts: DataFrame, by: str) -> DataFrame:
    """by, processed, failed, total."""
    return attempts.groupBy(by).agg(F.count_if(F.col("error").isNull()).alias("processed"), F.count_if(F.col("error").isNotNull()).alias("failed"), F.count("*").alias("total"))


def transformed(docs: DataFrame, transformations: list[tuple[str, str]], answer: Callable[[list[tuple[str, str]]], list[str]], id_col: str = "id", text_col: str = "full_text", retries: int = 5, wait: tuple[float, float] = WAIT) -> DataFrame:
    """source, insight_type, content: each named prompt (title, prompt) applied to each text; null texts give none."""
    each = F.array(*[F.struct(F.lit(t).alias("insight_type"), F.lit(p).alias("prompt")) for t, p in transformations])
    x = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("source"), F.col(text_col).alias("text"), F.explode(each).alias("t")).select("source", "t.insight_type", "t.prompt", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (s for batch in batches for s in slices(batch, "text")):
            asked = list(zip(b.column("prompt").to_pylist(), b.column("text").to_pylist(), strict=True))
            yield pa.RecordBatch.from_arrays([b.column("source"), b.column("insight_type"), pa.array(_tried(answer, asked, retries, wait) if asked else [], pa.string())], ["source", "insight_type", "content"])

    return x.mapInArrow(run, f"source {x.schema['source'].dataType.simpleString()}, insight_type string, content string")


def titled(notes: DataFrame, answer: Callable[[list[tuple[str, str]]], list[str]], prompt: str, **options) -> DataFrame:
    """Notes with a title: the answer to the prompt for notes of type ai that have content and no title (ids are unique)."""
    bare = (F.coalesce("title", F.lit("")) == "") & (F.col("note_type") == "ai") & (F.coalesce("content", F.lit("")) != "")
    made = transformed(notes.where(bare), [("title", prompt)], answer, "id", "content", **options).select(F.col("source").alias("__id"), F.col("content").alias("__title"))
    x = notes.join(made, F.col("id") == F.col("__id"), "left")
    return x.select(*[F.coalesce("__title", "title").alias(c) if c == "title" else F.col(c) for c in notes.columns])


def to_embed(source: DataFrame, embedding: DataFrame, note: DataFrame, insight: DataFrame, existing: bool) -> DataFrame:
    """type, id of what a rebuild embeds: what has vectors (existing), or all that has text."""
    has = (F.col("embedding").isNotNull()) & (F.size("embedding") > 0)
    text = lambda c: F.col(c).isNotNull() & (F.col(c) != "")
    pick = lambda df, kind, id="id": df.select(F.lit(kind).alias("type"), F.col(id).alias("id"))
    if existing:
        return pick(embedding.where(has).select("source").distinct(), "source", "source").unionByName(pick(note.where(has), "note")).unionByName(pick(insight.where(has), "insight"))
    return pick(source.where(text("full_text")), "source").unionByName(pick(note.where(text("content")), "note")).unionByName(pick(insight, "insight"))
