"""Dense vectors: normalising, embedding by hashing, exact top-k."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feuillet.functions.embedding import HashingModel


def norm(v: Column | str) -> Column:
    v = F.col(v) if isinstance(v, str) else v
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def l2_normalize(v: Column | str) -> Column:
    """The vector at length one; a zero vector stays."""
    v = F.col(v) if isinstance(v, str) else v
    n = norm(v)
    return F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0)))


def usable_vectors(df: DataFrame, dim: int, vector_col: str = "chunk_vectors", id_col: str = "chunk_id") -> DataFrame:
    """Rows whose vector has `dim` finite numbers, not all zero; a repeated id once."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.where((F.size(v) == dim) & finite & F.exists(v, lambda x: x != 0)).dropDuplicates([id_col])


def cosines(vectors: DataFrame, queries: list[tuple[int, list[float]]], vector_col: str, keep: list[str]) -> DataFrame:
    """qid, the kept columns and cosine for every vector and query. The queries are a driver-side list, a block of one matrix
    product per Arrow batch; vectors are never shuffled."""
    spark = vectors.sparkSession
    names = np.array([q for q, _ in queries], np.int64)
    matrix = np.array([v for _, v in queries], np.float64)
    matrix /= np.maximum(1e-300, np.linalg.norm(matrix, axis=1, keepdims=True))
    own = spark.sparkContext.broadcast((names, matrix))
    rows = vectors.select(*keep, F.col(vector_col).alias("__v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, q = own.value
        for batch in batches:
            if not batch.num_rows:
                continue
            v = batch.column(len(keep)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
            cos = (v @ q.T) / np.maximum(1e-300, np.linalg.norm(v, axis=1, keepdims=True))
            at = np.repeat(np.arange(batch.num_rows), len(qids))
            kept = batch.select(list(range(len(keep)))).take(pa.array(at))
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(qids, batch.num_rows)), *kept.columns, pa.array(np.round(cos.reshape(-1), 9))], names=["qid", *keep, "cosine"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[: len(keep)])
    return rows.mapInArrow(run, f"qid long, {fields}, cosine double")


def best_cosines(vectors: DataFrame, queries: list[tuple[int, list[float]]], vector_col: str, keep: list[str], k: int, by: str | None = None, block: int = 256, lists: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """The rows of `cosines` that can be among the k best of a query (and of a value of the kept column `by`): each Arrow
    batch is scored against one block of queries after the other and keeps its own k best, with all ties of the last. With
    `lists` (centres, and which of them each query wants) a vector is compared only with queries that want its list."""
    spark = vectors.sparkSession
    names = np.array([q for q, _ in queries], np.int64)
    matrix = np.array([v for _, v in queries], np.float64).reshape(len(queries), -1)
    matrix /= np.maximum(1e-300, np.linalg.norm(matrix, axis=1, keepdims=True))
    own = spark.sparkContext.broadcast((names, matrix, lists))
    rows = vectors.select(*keep, F.col(vector_col).alias("__v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, q, parts = own.value
        for batch in batches:
            if not batch.num_rows:
                continue
            v = batch.column(len(keep)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
            if parts is not None:
                nearest = (v @ parts[0].T).argmax(axis=1)
                for number in np.unique(nearest):
                    at, who = np.nonzero(nearest == number)[0], np.nonzero(parts[1][:, number])[0]
                    if len(who):
                        cos = np.round((v[at] @ q[who].T) / np.maximum(1e-300, np.linalg.norm(v[at], axis=1, keepdims=True)), 9)
                        least = np.partition(cos, len(at) - k, axis=0)[len(at) - k] if len(at) > k else np.full(len(who), -np.inf)
                        row, column = np.nonzero(cos >= least)
                        kept = batch.select(list(range(len(keep)))).take(pa.array(at[row]))
                        yield pa.RecordBatch.from_arrays([pa.array(qids[who[column]]), *kept.columns, pa.array(cos[row, column])], names=["qid", *keep, "cosine"])
                continue
            length = np.maximum(1e-300, np.linalg.norm(v, axis=1, keepdims=True))
            group = batch.column(keep.index(by)).dictionary_encode("encode").indices.to_numpy() if by else np.zeros(batch.num_rows, np.int64)
            members = [np.nonzero(group == g)[0] for g in np.unique(group)]
            for start in range(0, len(qids), block):
                cos = np.round((v @ q[start : start + block].T) / length, 9)
                for at in members:
                    part = cos[at]
                    least = np.partition(part, len(at) - k, axis=0)[len(at) - k] if len(at) > k else np.full(part.shape[1], -np.inf)
                    row, column = np.nonzero(part >= least)
                    kept = batch.select(list(range(len(keep)))).take(pa.array(at[row]))
                    yield pa.RecordBatch.from_arrays([pa.array(qids[start + column]), *kept.columns, pa.array(part[row, column])], names=["qid", *keep, "cosine"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[: len(keep)])
    return rows.mapInArrow(run, f"qid long, {fields}, cosine double")


def top_k(scored: DataFrame, k: int, by: list[str], id_col: str = "chunk_id") -> DataFrame:
    """The k rows of the largest cosine for each `by`, ties to the smaller id, with their rank. The limit runs before the shuffle."""
    w = Window.partitionBy(*by).orderBy(F.desc("cosine"), id_col)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def nearest_by_lists(vectors: DataFrame, queries: list[tuple[int, list[float]]], vector_col: str, k: int, id_col: str = "chunk_id", size: int = 1024, probes: int = 8) -> DataFrame:
    """qid, `id_col`, cosine, rank: approximate top-k. Vectors fall into lists of near ones (k-means on at most 20,000 of them),
    and each query is compared only with its `probes` nearest lists. Up to 64 vectors the comparison is exact."""
    total = vectors.count()
    if total <= 64:
        return top_k(best_cosines(vectors, queries, vector_col, [id_col], k), k, ["qid"], id_col)
    h = F.xxhash64(id_col)
    share = min(1.0, 24_000 / total)
    sample = (vectors.where(h <= F.lit(int(-(1 << 63) + share * ((1 << 64) - 1)))) if share < 1 else vectors).orderBy(h).limit(20_000).select(vector_col).collect()
    x = np.array([r[0] for r in sample], np.float64)
    x /= np.maximum(1e-300, np.linalg.norm(x, axis=1, keepdims=True))
    rng = np.random.default_rng(1)
    centres = x[rng.choice(len(x), max(1, min(len(x), -(-total // size), 512)), replace=False)]
    for _ in range(8):
        own = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres = np.where(np.any(sums, axis=1, keepdims=True), sums, centres)
        centres /= np.maximum(1e-300, np.linalg.norm(centres, axis=1, keepdims=True))
    q = np.array([v for _, v in queries], np.float64).reshape(len(queries), -1)
    wanted = np.zeros((len(queries), len(centres)), bool)
    np.put_along_axis(wanted, np.argsort(-(q @ centres.T), axis=1, kind="stable")[:, :probes], True, axis=1)
    return top_k(best_cosines(vectors, queries, vector_col, [id_col], k, lists=(centres, wanted)), k, ["qid"], id_col)


def hash_embedding(text: Column | str, dim: int = 64) -> Column:
    """A deterministic offline embedding: token counts in `dim` buckets (the first 32 bits of the token's MD5), at length one."""

    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = HashingModel(dim)
        for batch in batches:
            rows = model([t or "" for t in batch.to_pylist()])
            rows /= np.maximum(1e-300, np.linalg.norm(rows, axis=1, keepdims=True))
            yield pa.FixedSizeListArray.from_arrays(pa.array(rows.reshape(-1)), dim).cast(pa.list_(pa.float64()))

    return F.arrow_udf(count, "array<double>")(F.col(text) if isinstance(text, str) else text)
