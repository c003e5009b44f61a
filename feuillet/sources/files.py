"""Folders of office documents: scan, metadata, hashes and text.

Office formats are read with the standard library. PDF text and recognition of images need packages that may be missing;
they are looked for on the workers, and a file that can't be read gives an error text instead of ending the job.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feuillet.functions.text import file_suffix, is_supported, normalize_whitespace
from feuillet.sources.pages import animation_reader, file_readers, pdf_documents, route

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def scan(spark: SparkSession, folder: str, content: bool = False) -> DataFrame:
    """path, relative_path, file_name, file_type, modified_at (whole epoch seconds as text), size of every supported file;
    with `content` also the bytes and their SHA-256. Without it no file is opened. A missing folder raises."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    bare = r"^[a-z0-9]+:/+"
    base = "/" + re.sub(bare, "", folder).strip("/")
    local = F.concat(F.lit("/"), F.regexp_replace(F.regexp_replace("path", bare, ""), "^/+", ""))
    rows = files.where(is_supported("path")).select(
        "path", F.substring(local, len(base) + 2, 1 << 20).alias("relative_path"), F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name"), file_suffix("path").alias("file_type"),
        F.unix_seconds("modificationTime").cast("string").alias("modified_at"), F.col("length").alias("size"), *(["content"] if content else []),
    )
    return rows.withColumn("content_hash", F.sha2("content", 256)) if content else rows


def _part(archive: zipfile.ZipFile, name: str) -> ElementTree.Element:
    return ElementTree.fromstring(archive.read(name))


def word_text(data: bytes) -> str:
    """Non-blank paragraphs of the body, tables and headers left out, an empty line between them."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = _part(z, "word/document.xml").find(f"{_W}body")
    paragraphs = ("".join(t.text or "" for t in p.iter(f"{_W}t")).strip() for p in body.findall(f"{_W}p"))
    return "\n\n".join(p for p in paragraphs if p)


def _date_styles(archive: zipfile.ZipFile) -> set[int]:
    """Numbers of the cell styles that show dates or times."""
    if "xl/styles.xml" not in archive.namelist():
        return set()
    styles = _part(archive, "xl/styles.xml")
    own = {int(f.get("numFmtId")): re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", f.get("formatCode", "")) for f in styles.iter(f"{_S}numFmt")}
    dates = {*range(14, 23), *range(45, 48), *(n for n, code in own.items() if re.search("[ymdhs]", code, re.I) and "General" not in code)}
    cells = styles.find(f"{_S}cellXfs")
    return {n for n, x in enumerate(cells if cells is not None else ()) if int(x.get("numFmtId", 0)) in dates}


def _cell(c: ElementTree.Element, shared: list[str], dates: set[int]) -> str:
    """A cell as text: strings as they are, numbers without a needless form, truth values and dates spelled out."""
    value, kind = c.find(f"{_S}v"), c.get("t", "n")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in c.iter(f"{_S}t"))
    text = (value.text or "") if value is not None else ""
    if not text.strip() or kind in ("str", "e", "d"):
        return text
    if kind == "s":
        return shared[int(text)]
    if kind == "b":
        return str(text.strip() == "1")
    number = float(text) if re.search("[.eE]", text) else int(text)
    if int(c.get("s", 0)) in dates:
        if 0 <= number < 1:
            return str((datetime(1900, 1, 1) + timedelta(seconds=round(86400 * number))).time())
        return str(datetime(1899, 12, 30) + timedelta(seconds=round(86400 * number)))  # day 60 is one that never was
    return str(number)


def sheet_text(data: bytes) -> str:
    """`Sheet: <title>` and the rows of each sheet that has any, cells joined by ` | `; values as cached by the program."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = ["".join(t.text or "" for t in s.iter(f"{_S}t")) for s in _part(z, "xl/sharedStrings.xml").findall(f"{_S}si")] if "xl/sharedStrings.xml" in names else []
        dates = _date_styles(z)
        target = _targets(z, "xl/_rels/workbook.xml.rels")
        out = []
        for sheet in _part(z, "xl/workbook.xml").iter(f"{_S}sheet"):
            lines = []
            for row in _part(z, "xl/" + target[sheet.get(f"{_R}id")].removeprefix("xl/")).iter(f"{_S}row"):
                cells = (_cell(c, shared, dates).strip() for c in row.findall(f"{_S}c"))
                lines.append(" | ".join(x for x in cells if x))
            lines = [x for x in lines if x]
            if lines:
                out += [f"Sheet: {sheet.get('name')}", "\n".join(lines)]
    return "\n\n".join(out)


def _targets(archive: zipfile.ZipFile, name: str) -> dict[str, str]:
    return {r.get("Id"): r.get("Target").lstrip("/") for r in _part(archive, name)}


def _slides(archive: zipfile.ZipFile) -> list[str]:
    """The slides in the order of the presentation, or of their numbers where it has none."""
    names = [n for n in archive.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)]
    if {"ppt/presentation.xml", "ppt/_rels/presentation.xml.rels"} <= set(archive.namelist()):
        target = _targets(archive, "ppt/_rels/presentation.xml.rels")
        listed = [target.get(s.get(f"{_R}id"), "") for s in _part(archive, "ppt/presentation.xml").iter(f"{_P}sldId")]
        return [n for n in ("ppt/" + t.removeprefix("ppt/") for t in listed) if n in names]
    return sorted(names, key=lambda n: int(re.findall(r"\d+", n)[-1]))


def _shape_lines(shape: ElementTree.Element) -> list[str]:
    """The rows of a table, or the paragraphs of anything else as one piece."""
    text = lambda x: "\n".join("".join(t.text or "" for t in p.iter(f"{_A}t")) for p in x.iter(f"{_A}p")).strip()
    tables = list(shape.iter(f"{_A}tbl"))
    if tables:
        return [" | ".join(x for x in map(text, row.findall(f"{_A}tc")) if x) for t in tables for row in t.iter(f"{_A}tr")]
    return [text(shape)]


def slide_text(data: bytes) -> str:
    """`Slide <n>` and the texts of each slide that has any, shape by shape, table rows joined by ` | `; n counts empty slides too."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        out = []
        for number, name in enumerate(_slides(z), 1):
            tree = _part(z, name)
            shapes = tree.find(f".//{_P}spTree")
            lines = [line for shape in (tree if shapes is None else shapes) if shape.tag != f"{_P}grpSp" for line in _shape_lines(shape) if line]
            if lines:
                out += [f"Slide {number}", "\n".join(lines)]
    return "\n\n".join(out)


def pdf_text(data: bytes) -> str:
    from pypdf import PdfReader

    return "\n\n".join(t for t in (p.extract_text() or "" for p in PdfReader(io.BytesIO(data)).pages) if t.strip())


def image_text(data: bytes) -> str:
    from rapidocr_onnxruntime import RapidOCR

    global _recogniser
    _recogniser = globals().get("_recogniser") or RapidOCR()
    found, _ = _recogniser(data)
    return "\n".join(line[1] for line in found or [])


def gif_text(data: bytes) -> str:
    from rapidocr_onnxruntime import RapidOCR  # noqa: F401 - tells that it is missing

    readers = file_readers()
    return animation_reader(readers["frames"], readers["recognise"])(data)


READERS: dict[str, Callable[[bytes], str]] = {".docx": word_text, ".xlsx": sheet_text, ".pptx": slide_text, ".pdf": pdf_text, ".gif": gif_text, **dict.fromkeys((".png", ".jpg", ".jpeg", ".bmp", ".tiff", ".webp"), image_text)}


def extract(files: DataFrame, readers: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """`files` (with content, file_type, content_hash) with text and error instead of the content. Equal contents are read once:
    the distinct hashes are extracted and joined back."""
    table = {**READERS, **(readers or {})}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for suffix, data in zip(batch["file_type"], batch["content"]):
                try:
                    out.append((table[suffix](bytes(data)), None))
                except Exception as e:  # noqa: BLE001 - a broken file must not end the job
                    out.append((None, f"{type(e).__name__}: {e}"[:200]))
            yield pd.DataFrame({"content_hash": batch["content_hash"], "file_type": batch["file_type"], "text": [t for t, _ in out], "error": [e for _, e in out]})

    once = files.dropDuplicates(["content_hash", "file_type"]).select("content_hash", "file_type", "content")
    texts = once.mapInPandas(run, "content_hash string, file_type string, text string, error string")
    return files.drop("content").join(texts.withColumn("text", normalize_whitespace("text")), ["content_hash", "file_type"], "left")


route_pdf = route


def extract_documents(files: DataFrame, pdf_readers: dict[str, Callable] | None = None, readers: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """`extract`, with PDFs by the chain of pages and images if all its readers are there: their text, what their images add,
    or the recognised pages. Equal contents are read once."""
    pdf = pdf_readers if pdf_readers is not None else file_readers()
    if not {"native", "images", "render", "recognise"} <= pdf.keys():
        return extract(files, readers)
    others = extract(files.where("file_type <> '.pdf'"), readers)
    own = files.where("file_type = '.pdf'")
    once = own.dropDuplicates(["content_hash"]).select(F.col("content_hash").alias("path"), "content")
    texts = pdf_documents(once, pdf).select(F.col("path").alias("content_hash"), "text")
    read = own.drop("content").join(texts, "content_hash", "left").withColumn("error", F.when(F.col("text").isNull(), "the PDF can't be read"))
    return others.unionByName(read)
