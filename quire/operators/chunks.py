"""Token-aware chunks of texts: the coarsest separator first, finer ones only inside pieces that are too long."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Separators from coarse to fine.
SEPARATORS = ["\n\n", "\n", ".", ",", " ", "\u200b", "\uff0c", "\u3001", "\uff0e", "\u3002", ""]


def word_tokens(text: str) -> int:
    return int(len(text.split()) * 1.3)


def _pieces(text: str, separator: str) -> list[str]:
    """The text cut before each separator."""
    if not separator:
        return list(text)
    first, *rest = text.split(separator)
    return [p for p in [first, *(separator + r for r in rest)] if p]


def split_text(text: str, size: int = 500, overlap: int | None = None, length: Callable[[str], int] = word_tokens, separators: list[str] = SEPARATORS) -> list[str]:
    """Chunks of up to `size` tokens; neighbours share up to `overlap` tokens of whole pieces (15 % unless given)."""
    overlap = int(size * 0.15) if overlap is None else overlap
    at = next(i for i, s in enumerate(separators) if not s or s in text)
    chunks: list[str] = []
    held: list[tuple[str, int]] = []
    total = 0

    def close() -> None:
        joined = "".join(p for p, _ in held).strip()
        if joined:
            chunks.append(joined)

    for piece in _pieces(text, separators[at]):
        n = length(piece)
        if n >= size and separators[at]:
            close()
            held, total = [], 0
            chunks += split_text(piece, size, overlap, length, separators[at + 1 :])
            continue
        if held and total + n > size:
            close()
            while held and (total > overlap or total + n > size):
                total -= held.pop(0)[1]
        held.append((piece, n))
        total += n
    close()
    return chunks


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive rows with about `most` bytes of text; one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + most, "right")))
        yield batch.slice(first, last - first)
        first = last


def chunked(docs: DataFrame, id_col: str = "id", text_col: str = "full_text", size: int = 500) -> DataFrame:
    """id, order (from 0) and content of each chunk; null and blank texts have none."""
    x = docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, "text"):
                cut = [split_text(t, size) if t else [] for t in part.column("text").to_pylist()]
                index = pa.array([i for i, c in enumerate(cut) for _ in c], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("id").take(index), pa.array([k for c in cut for k in range(len(c))], pa.int32()), pa.array([t for c in cut for t in c], pa.string())], ["id", "order", "content"])

    return x.mapInArrow(run, f"id {x.schema['id'].dataType.simpleString()}, `order` int, content string")
