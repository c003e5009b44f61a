"""Passages of a fixed size, cut at line ends where one is near."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE, OVERLAP = 900, 150  # fixed values of the index


def line_ends(text: str) -> list[int]:
    found, at = [], text.find("\n")
    while at >= 0:
        found.append(at)
        at = text.find("\n", at + 1)
    return found


def passages(text: str | None, size: int = SIZE, overlap: int = OVERLAP) -> list[str]:
    """The trimmed, non-empty passages of a text; none for null or blank ones. A passage ends at the last line end of its
    final size - overlap characters, if there is one, and the next starts `overlap` characters before that end."""
    text = (text or "").strip()
    ends = line_ends(text) if len(text) > size else []
    bounds, low = [], 0
    while low + size < len(text):
        nearest = bisect_left(ends, low + size) - 1
        high = ends[nearest] if nearest >= 0 and ends[nearest] >= low + overlap else low + size
        bounds.append((low, high))
        low = max(high - overlap, low + 1)
    bounds.append((low, len(text)))
    return [p for p in (text[a:b].strip() for a, b in bounds) if p]


def explode_passages(df: DataFrame, text_col: str, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """The other columns with chunk_no (from 0) and the passage in `text_col`. One narrow pass, Arrow batches in and out."""
    keep = [c for c in df.columns if c != text_col]

    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([passages(t, size, overlap) for t in batch.to_pylist()], pa.list_(pa.string()))

    split = F.arrow_udf(cut, "array<string>")
    return df.select(*keep, F.posexplode(split(F.col(text_col))).alias("chunk_no", text_col))
