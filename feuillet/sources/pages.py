"""Pages and images of documents: raster detection, unique images, recognition once per image, text in page order.

The relational part works on tables of pages (path, page_no, native) and images (path, page_no, position, width, height,
image); what opens a file or recognises an image is a function that the caller gives, so any package can be put in.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from feuillet.functions.text import looks_garbled, merge_text_layers, normalize_whitespace

# Areas in pixels, pages looked at, side of a fingerprint, resolution of a rendered page.
LEAST_AREA, RASTER_AREA, RASTER_PAGES, SIDE, RENDER_DPI = 1000, 40_000, 5, 32, 200


def _in_order(df: DataFrame, value: str, *order: str) -> DataFrame:
    """path and the non-empty values in order, an empty line between them, normalised. A document's pages are one group."""
    rows = df.where(F.length(F.trim(value)) > 0).groupBy("path").agg(F.array_sort(F.collect_list(F.struct(*order, value))).alias("x"))
    return rows.select("path", normalize_whitespace(F.array_join(F.transform("x", lambda x: x[value]), "\n\n")).alias("text"))


def native_text(pages: DataFrame) -> DataFrame:
    """path, text: the native text of the pages in order."""
    return _in_order(pages, "native", "page_no")


def page_text(recognised: DataFrame) -> DataFrame:
    """path, text: the recognised text of rendered pages (path, page_no, text), in the order of pages, whatever task read them."""
    return _in_order(recognised.withColumnRenamed("text", "read"), "read", "page_no")


def raster_flags(images: DataFrame) -> DataFrame:
    """path, has_raster (an image of more than RASTER_AREA pixels on the first pages), n_images. Pages count from 0."""
    large = (F.col("width") * F.col("height") > RASTER_AREA) & (F.col("page_no") < RASTER_PAGES)
    return images.groupBy("path").agg(F.bool_or(large).alias("has_raster"), F.count("*").alias("n_images"))


def fingerprint(image: np.ndarray) -> str:
    """MD5 of the image in grey, scaled to 32 x 32 by the means of its cells; copies of a logo have the same one."""
    grey = image @ np.array([0.299, 0.587, 0.114]) if image.ndim == 3 else image.astype(float)
    for axis in (0, 1):
        edges = np.linspace(0, grey.shape[axis], SIDE + 1)
        # Means over cells with fractional edges, from the running sum.
        total = np.insert(np.cumsum(grey, axis=axis), 0, 0, axis=axis)
        low = np.minimum(edges.astype(int), grey.shape[axis] - 1)
        part = np.expand_dims(edges - low, 1 - axis)
        at = np.take(total, low, axis=axis) + part * np.take(grey, low, axis=axis)
        grey = np.diff(at, axis=axis) / (grey.shape[axis] / SIDE)
    return hashlib.md5(np.clip(np.round(grey), 0, 255).astype(np.uint8).tobytes()).hexdigest()


def raw_fingerprint(width: Column | str = "width", height: Column | str = "height", image: Column | str = "image") -> Column:
    """Fingerprint of images given as raw RGB bytes, in Arrow batches; null where the size doesn't fit."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for widths, heights, data in batches:
            out = []
            for w, h, d in zip(widths.to_pylist(), heights.to_pylist(), data.to_pylist()):
                out.append(fingerprint(np.frombuffer(d, np.uint8).reshape(h, w, 3)) if d and w and h and len(d) == 3 * w * h else None)
            yield pa.array(out, pa.string())

    return F.arrow_udf(run, "string")(F.col(width), F.col(height), F.col(image))


def unique_images(images: DataFrame) -> DataFrame:
    """The images of each path (with a fingerprint) that are no decoration, each once, where it stands first."""
    own = images.where((F.col("width") * F.col("height") >= LEAST_AREA) & F.col("fingerprint").isNotNull())
    rest = [c for c in own.columns if c not in ("path", "fingerprint")]
    return own.groupBy("path", "fingerprint").agg(F.min_by(F.struct(*rest), F.struct("page_no", "position")).alias("x")).select("path", "fingerprint", "x.*")


def recognise_once(images: DataFrame, recognise: Callable[[bytes], str], known: DataFrame | None = None) -> DataFrame:
    """fingerprint, text of every distinct image. Those in `known` (fingerprint, text), the stored cache, are not read again; an
    image that can't be read has an empty text."""
    once = images.groupBy("fingerprint").agg(F.first("image").alias("image"))
    if known is not None:
        once = once.join(known, "fingerprint", "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for data in batch.column(1).to_pylist():
                try:
                    texts.append(recognise(data) or "")
                except Exception:  # noqa: BLE001 - a broken image must not end the job
                    texts.append("")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["fingerprint", "text"])

    read = once.select("fingerprint", "image").mapInArrow(run, "fingerprint string, text string")
    return read if known is None else read.unionByName(known.join(images.select("fingerprint").distinct(), "fingerprint", "left_semi").select("fingerprint", "text"))


def image_text(unique: DataFrame, texts: DataFrame) -> DataFrame:
    """path, text: what the unique images of a path say, in the order of pages and positions."""
    return _in_order(unique.join(texts.withColumnRenamed("text", "read"), "fingerprint"), "read", "page_no", "position")


def frame_numbers(n: Column | str) -> Column:
    """Frames of an animation that are read: all of up to three, else the first, the middle and the last."""
    n = F.col(n) if isinstance(n, str) else n
    return F.when(n <= 0, F.array().cast("array<int>")).when(n <= 3, F.sequence(F.lit(0), n - 1)).otherwise(F.array(F.lit(0), F.floor(n / 2).cast("int"), (n - 1).cast("int")))


def animation_text(frames: DataFrame) -> DataFrame:
    """path, text of recognised frames (path, frame_no, n_frames, text): the chosen ones in order, equal texts once."""
    chosen = frames.where(F.array_contains(frame_numbers(F.col("n_frames").cast("int")), F.col("frame_no").cast("int")) & (F.length("text") > 0))
    first = chosen.groupBy("path", "text").agg(F.min("frame_no").alias("frame_no")).withColumnRenamed("text", "read")
    return _in_order(first, "read", "frame_no")


def route(documents: DataFrame) -> DataFrame:
    """path, case, text of PDFs given native text, has_raster (null if unknown: then it is looked at), image_text and page_text.

    A: text and no raster image, the text as it is. B: text and raster images, what the images add comes after it. C: no or
    garbled text, it is merged with the recognised pages, or with the images where the pages gave nothing."""
    none = F.lit("")
    native = F.coalesce("native", none)
    case = F.when((native == "") | looks_garbled(native), "C").when(F.coalesce("has_raster", F.lit(True)), "B").otherwise("A")
    read = F.when(case == "C", F.coalesce(F.nullif(F.col("page_text"), none), F.col("image_text"))).when(case == "B", F.col("image_text"))
    text = F.when(F.length(F.coalesce(read, none)) > 0, merge_text_layers(native, read)).otherwise(native)
    return documents.select("path", case.alias("case"), text.alias("text"))


def documents_text(pages: DataFrame, images: DataFrame, recognise: Callable[[bytes], str], rendered: DataFrame | Callable[[DataFrame], DataFrame] | None = None, known: DataFrame | None = None) -> DataFrame:
    """path, case, text of a table of documents: pages with native text, images with fingerprints and, for documents
    without usable text, rendered pages (path, page_no, image), or what gives them for the paths that need them. Only what a
    case needs is rendered and recognised."""
    native = native_text(pages).withColumnRenamed("text", "native")
    base = pages.select("path").distinct().join(native, "path", "left").join(raster_flags(images), "path", "left").withColumn("has_raster", F.coalesce("has_raster", F.lit(False)))
    case = route(base.withColumn("image_text", F.lit(None).cast("string")).withColumn("page_text", F.lit(None).cast("string"))).select("path", "case")
    unique = unique_images(images.join(case.where("case <> 'A'"), "path", "left_semi"))
    read = image_text(unique, recognise_once(unique, recognise, known)).withColumnRenamed("text", "image_text")
    if rendered is not None:
        wanted = case.where("case = 'C'").select("path")
        own = rendered(wanted) if callable(rendered) else rendered.join(wanted, "path", "left_semi")
        own = own.withColumn("fingerprint", F.sha2("image", 256))
        texts = recognise_once(own, recognise)
        whole = page_text(own.join(texts, "fingerprint").select("path", "page_no", "text")).withColumnRenamed("text", "page_text")
        base = base.join(whole, "path", "left")
    else:
        base = base.withColumn("page_text", F.lit(None).cast("string"))
    return route(base.join(read, "path", "left"))


def file_readers() -> dict[str, Callable]:
    """Functions on the bytes of a file by the packages that are there: `native` and `images` by pypdf, `render` by pypdfium2,
    `frames` by Pillow, `recognise` by RapidOCR. A missing package leaves its function out."""
    import io

    out: dict[str, Callable] = {}
    try:
        from pypdf import PdfReader

        out["native"] = lambda data: [p.extract_text() or "" for p in PdfReader(io.BytesIO(data)).pages]
        out["images"] = lambda data: [(n, k, *i.image.size, i.image.convert("RGB").tobytes()) for n, p in enumerate(PdfReader(io.BytesIO(data)).pages) for k, i in enumerate(p.images)]
    except ImportError:
        pass
    try:
        import pypdfium2

        out["render"] = lambda data: [np.asarray(p.render(scale=RENDER_DPI / 72).to_pil().convert("RGB")) for p in pypdfium2.PdfDocument(data)]
    except ImportError:
        pass
    try:
        from PIL import Image, ImageSequence

        out["frames"] = lambda data: [np.asarray(f.copy().convert("RGB")) for f in ImageSequence.Iterator(Image.open(io.BytesIO(data)))]
    except ImportError:
        pass
    try:
        from rapidocr_onnxruntime import RapidOCR

        model: list = []
        out["recognise"] = lambda image: "\n".join(line[1] for line in ((model or model.append(RapidOCR()) or model)[0](image)[0] or []))
    except ImportError:
        pass
    return out


def explode_file(files: DataFrame, read: Callable[[bytes], list[tuple]], schema: str) -> DataFrame:
    """path and the rows that `read` gives for the content of each file, such as pages or images; a broken file gives none."""
    wanted = StructType.fromDDL("path string, " + schema)
    arrow = to_arrow_schema(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    rows = [(path, *r) for r in read(bytes(data))]
                except Exception:  # noqa: BLE001 - a broken file must not end the job
                    rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    return files.select("path", "content").mapInArrow(run, wanted)


def pdf_documents(files: DataFrame, readers: dict[str, Callable]) -> DataFrame:
    """path, case, text of PDF files (path, content) by the readers given: `native` (texts of the pages), `images` (page,
    position, width, height, RGB bytes), `render` (bytes of the rendered pages), `recognise` (text of an image). A broken file
    has no row. Only files without usable text are rendered."""
    native = explode_file(files, lambda data: list(enumerate(readers["native"](data))), "page_no int, native string")
    images = explode_file(files, readers["images"], "page_no int, position int, width int, height int, image binary").withColumn("fingerprint", raw_fingerprint())
    render = lambda paths: explode_file(files.join(paths, "path", "left_semi"), lambda data: list(enumerate(readers["render"](data))), "page_no int, image binary")
    return documents_text(native, images, readers["recognise"], render)


def animation_reader(frames: Callable[[bytes], list], recognise: Callable[[object], str]) -> Callable[[bytes], str]:
    """A reader of animations: what the first, middle and last frame say (all of up to three), equal texts once."""
    def read(data: bytes) -> str:
        all_frames = frames(data)
        n = len(all_frames)
        chosen = range(n) if n <= 3 else (0, n // 2, n - 1)
        return "\n\n".join(dict.fromkeys(t for t in (recognise(all_frames[k]) for k in chosen) if t))

    return read
