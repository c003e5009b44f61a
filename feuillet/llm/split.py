"""Oversized texts cut at natural boundaries, with overlap.

A separator hierarchy (section, paragraph, line, sentence, word, character) is applied recursively until every piece
fits; the pieces are then packed greedily. All work is on offsets, so a passage is always an exact slice of the
trimmed text and the slices cover it without a gap.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from feuillet.plans.spread import spread

TRIM = " \t\r\n"
# A separator belongs to the piece before it.
LEVELS = (
    ("section", re.compile(r"\f+|(?:\r?\n[ \t]*){3,}|\n(?=#{1,6} )")),
    ("paragraph", re.compile(r"(?:\r\n|\n|\r)[ \t]*(?:\r\n|\n|\r)[ \t\r\n]*")),
    ("line", re.compile(r"\r\n|\n|\r")),
    ("sentence", re.compile(r"(?<=[.!?…])[\"'»”’)\]]*\s+")),
    ("word", re.compile(r"\s+")),
)
PASSAGE_SCHEMA = "passage_no int, start int, end int, boundary string, passage string"


def pieces(text: str, start: int, end: int, limit: int, level: int = 0) -> Iterator[tuple[int, int, str]]:
    """Contiguous slices (start, end, boundary that ends the slice) of at most `limit` characters."""
    if end - start <= limit:
        yield start, end, "end"
        return
    if level == len(LEVELS):
        at = start
        while at < end:
            cut = min(end, at + limit)
            while cut < end and cut > at + 1 and unicodedata.category(text[cut])[0] == "M":
                cut -= 1  # a mark stays with its letter
            cut = cut if cut > at + 1 else min(end, at + limit)
            yield at, cut, "character"
            at = cut
        return
    name, separator = LEVELS[level]
    at = start
    cuts = [m.end() for m in separator.finditer(text, start, end) if start < m.end() < end]
    for cut in [*cuts, end]:
        if cut - at > limit:
            *head, last = pieces(text, at, cut, limit, level + 1)
            yield from head
            yield last[0], last[1], name
        else:
            yield at, cut, name
        at = cut


def split_text(text: str | None, limit: int = 900, overlap: int = 150) -> list[tuple[int, int, int, str, str]]:
    """(passage_no, start, end, boundary, passage) of one text; offsets count from the start of the trimmed text.

    Null, empty and blank texts have no passage; a text of at most `limit` characters is one passage.
    """
    if limit <= 2 * overlap or overlap < 0:
        raise ValueError("the limit must be more than twice the overlap")
    text = (text or "").strip(TRIM)
    if not text:
        return []
    if len(text) <= limit:
        return [(1, 0, len(text), "end", text)]
    out: list[tuple[int, int, int, str, str]] = []
    start, end, kind = 0, 0, ""

    def close() -> None:
        out.append((len(out) + 1, start, end, kind, text[start:end]))

    for low, high, boundary in pieces(text, 0, len(text), limit - overlap):
        if high - start > limit:
            close()
            start = overlap_start(text, low, overlap)
        end, kind = high, boundary
    kind = "end"
    close()
    return out


def overlap_start(text: str, cut: int, overlap: int) -> int:
    """Where the passage after `cut` starts: `overlap` characters back, moved to the next word if one is near."""
    at = max(0, cut - overlap)
    if not overlap or text[at - 1 : at].isspace():
        return at
    word = re.compile(r"\s+").search(text, at, min(cut, at + overlap // 3))
    return word.end() if word else at


def split_oversized(
    df: DataFrame, text_col: str = "extracted_text", id_col: str = "id", limit: int = 900, overlap: int = 150,
    only_oversized: bool = True,
) -> DataFrame:
    """One row per passage: `id_col`, passage_no (from 1), start, end, boundary, passage.

    Null, empty and blank texts give no row. Texts of at most `limit` characters give no row, or with
    `only_oversized=False` one. Repeated ids are cut row by row. Only the two columns are read, so other columns, whatever
    their names, play no part. An empty table gives an empty result. One narrow pass over the texts; only a table smaller than a
    split a core is dealt out first.
    """
    source = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    arrow_id = pa.field("id", pa.string() if dict(source.dtypes)["id"] == "string" else pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([arrow_id, ("passage_no", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("boundary", pa.string()), ("passage", pa.string())])
        for batch in batches:
            rows: list[tuple] = []
            size = 0
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = split_text(text, limit, overlap)
                if len(found) > 1 or found and not only_oversized:
                    rows += [(key, *x) for x in found]
                    size += sum(len(x[4]) for x in found)
                if size > 16_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    rows, size = [], 0
            columns = zip(*rows) if rows else [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    kind = "string" if arrow_id.type == pa.string() else "long"
    return spread(source).mapInArrow(run, f"id {kind}, {PASSAGE_SCHEMA}").withColumnRenamed("id", id_col)
