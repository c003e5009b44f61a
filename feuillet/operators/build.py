"""Building and synchronising an index: scan, extract, cut, embed, index, publish."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feuillet.functions.chunking import explode_passages
from feuillet.functions.embedding import with_embedding
from feuillet.functions.text import category_of
from feuillet.operators import lexical, sync
from feuillet.operators.fusion import SearchIndex
from feuillet.plans.numbering import number_rows
from feuillet.plans.shared import write_shared
from feuillet.sources.store import IndexStore

META = ("relative_path", "file_name", "file_type", "category", "chunk_no", "text")


@dataclass
class SyncReport:
    """What a synchronisation did: mode (complete, incremental, unchanged), number of documents with passages, changes
    (relative_path, change_type), the new catalogue, and the error that made it rebuild everything, if any."""

    mode: str
    documents_indexed: int
    changes: DataFrame | None
    catalogue: DataFrame
    error: str | None = None


def passages_of(documents: DataFrame) -> DataFrame:
    """The passages of documents (relative_path, file_name, file_type, text), not numbered over all yet."""
    rows = documents.where(F.length("text") > 0).select("relative_path", "file_name", "file_type", category_of("relative_path").alias("category"), "text")
    return explode_passages(rows, "text").select(*META)


def assemble(passages: DataFrame, with_vectors: DataFrame) -> dict[str, DataFrame]:
    """The tables of an index: passages numbered in the order of category, path and number, their vectors, the lexical index
    over all of them. `with_vectors` has (relative_path, chunk_no, vector)."""
    chunks = write_shared(number_rows(passages, ["category", "relative_path", "chunk_no"], "chunk_id"), "chunks")
    vectors = chunks.select("chunk_id", "category", "relative_path", "chunk_no").join(with_vectors, ["relative_path", "chunk_no"])
    built = lexical.build_index(chunks)
    return {"chunks": chunks, "vectors": vectors.select("chunk_id", "category", "relative_path", "chunk_no", "vector"), "postings": lexical.bucketed(built.postings), "term_stats": built.term_stats, "corpus_stats": built.corpus_stats}


def _publish(store: IndexStore, tables: dict[str, DataFrame], model: str) -> int:
    store.publish(tables["chunks"], {k: v for k, v in tables.items() if k != "chunks"}, model)
    return store.load("chunks").select("relative_path").distinct().count()


def full_build(store: IndexStore, files: DataFrame, extract: Callable[[DataFrame], DataFrame], catalogue: DataFrame, model: str = "hash-64") -> SyncReport:
    """Everything anew. `files` is a scan with content hashes, `extract` adds their text; the catalogue takes all files, the
    index those with a text. Without a single text ValueError is raised and nothing published."""
    documents = write_shared(extract(files).drop("content"), "documents")
    passages = write_shared(with_embedding(passages_of(documents), "text", model), "passages")
    if passages.isEmpty():
        raise ValueError("no document with a text was found")
    n = _publish(store, assemble(passages.drop("vector"), passages.select("relative_path", "chunk_no", "vector")), model)
    return SyncReport("complete", n, None, _catalogue(catalogue, documents, documents))


def _catalogue(old: DataFrame, changed: DataFrame, current: DataFrame) -> DataFrame:
    incoming = changed.select(*(c for c in changed.columns if c in old.columns))
    return write_shared(sync.delete_not_in(sync.upsert(old, incoming), current), "catalogue")


def incremental_build(store: IndexStore, files: DataFrame, changes: DataFrame, extract: Callable[[DataFrame], DataFrame], catalogue: DataFrame, model: str) -> SyncReport:
    """Only added and updated files are extracted and embedded; the passages and vectors of the others are taken over, those of
    updated and deleted ones go. Lexical statistics are of all passages, so they are computed again."""
    removed, changed = sync.touched(changes)
    fresh_files = files.join(changed, "relative_path", "left_semi")
    documents = write_shared(extract(fresh_files).drop("content"), "documents")
    fresh = with_embedding(passages_of(documents), "text", model)
    kept = store.load("chunks").drop("chunk_id").join(store.load("vectors").select("relative_path", "chunk_no", "vector"), ["relative_path", "chunk_no"])
    passages = write_shared(kept.join(removed, "relative_path", "left_anti").select(*META, "vector").unionByName(fresh), "passages")
    n = _publish(store, assemble(passages.drop("vector"), passages.select("relative_path", "chunk_no", "vector")), model)
    return SyncReport("incremental", n, changes, _catalogue(catalogue, documents, files))


def run_sync(store: IndexStore, files: DataFrame, extract: Callable[[DataFrame], DataFrame], catalogue: DataFrame, model: str = "hash-64") -> SyncReport:
    """Nothing published yet: a full build. No change: everything stays. Else an incremental build; if that fails, a full one,
    with the error in the report. Files whose stored time is the same keep their stored hash (`sync.reuse_hashes`)."""
    if store.manifest() is None:
        return full_build(store, files, extract, catalogue, model)
    changes = write_shared(sync.detect_changes(files, catalogue), "changes")
    if changes.isEmpty():
        return SyncReport("unchanged", store.load("chunks").select("relative_path").distinct().count(), changes, catalogue)
    try:
        return incremental_build(store, files, changes, extract, catalogue, model)
    except Exception as e:  # noqa: BLE001 - whatever broke it, the full build puts right
        report = full_build(store, files, extract, catalogue, model)
        report.changes, report.error = changes, f"{type(e).__name__}: {e}"[:500]
        return report


def load_index(store: IndexStore) -> SearchIndex:
    """The published index, ready for searches; raises FileNotFoundError without one."""
    return SearchIndex(store.load("chunks"), store.load("vectors"), lexical.LexicalIndex(store.load("postings"), store.load("term_stats"), store.load("corpus_stats")))


def validated(store: IndexStore, documents: DataFrame) -> DataFrame:
    """relative_path, problem of the documents whose stored passages are not, in order and text, those cut now (missing,
    gone or changed). An empty result means that the stored index can be used as it is."""
    cut = lambda df: df.groupBy("relative_path").agg(F.array_sort(F.collect_list(F.struct("chunk_no", F.xxhash64("text").alias("h")))).alias("x"))
    both = cut(store.load("chunks")).withColumnRenamed("x", "stored").join(cut(passages_of(documents)), "relative_path", "full_outer")
    problem = F.when(F.col("stored").isNull(), "missing").when(F.col("x").isNull(), "gone").when(F.col("stored") != F.col("x"), "changed")
    return both.select("relative_path", problem.alias("problem")).where("problem is not null")
