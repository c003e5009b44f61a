"""Hybrid ranking: reciprocal-rank fusion of dense and lexical lists, boosts, document aggregation, filters.

Everything is batched over queries(qid, query, top_k, category, file_type), so one query or a thousand are one plan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feuillet.functions.text import contains_all_terms, query_terms, text_preview
from feuillet.operators.lexical import LexicalIndex, bm25_scores
from feuillet.operators.vector import best_cosines
from feuillet.plans.shared import write_shared

# Fixed values of the ranking.
RRF_K, DEPTH, LEAST_DEPTH = 60, 4, 40
CHUNK_BOOST, DOCUMENT_BOOST, FLOOR, THRESHOLD = 2.0, 3.0, 90.0, 0.30
COSINE_LOW, COSINE_RANGE, BEST = 0.1, 0.65, 3


@dataclass
class SearchIndex:
    """chunks(chunk_id, relative_path, file_name, file_type, category, text), vectors(chunk_id, category, vector), lexical."""

    chunks: DataFrame
    vectors: DataFrame
    lexical: LexicalIndex


def deepest(queries: DataFrame) -> int:
    """The longest list that any query of the batch wants: a literal, so that the limit runs before the shuffle."""
    return queries.agg(F.max(F.greatest(F.lit(LEAST_DEPTH), DEPTH * F.col("top_k")))).first()[0] or LEAST_DEPTH


def dense_ranks(index: SearchIndex, queries: DataFrame, vectors: list[tuple[int, list[float]]]) -> DataFrame:
    """qid, chunk_id, cosine, dense_rank: the best of each wanted category, ranked over all of them. Each batch of vectors keeps
    its own best of a category, then each task, so few rows a query and category are shuffled."""
    limit = queries.select("qid", F.col("category").alias("only"), F.greatest(F.lit(LEAST_DEPTH), DEPTH * F.col("top_k")).alias("m"))
    most = deepest(queries)
    near = best_cosines(index.vectors, vectors, "vector", ["chunk_id", "category"], most, "category")
    w = Window.partitionBy("qid", "category").orderBy(F.desc("cosine"), "chunk_id")
    best = near.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).join(limit, "qid").where((F.col("r") <= F.col("m")) & (F.col("only").isNull() | (F.col("only") == F.col("category"))))
    return best.select("qid", "chunk_id", "cosine", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("cosine"), "chunk_id")).alias("dense_rank"))


def lexical_ranks(index: SearchIndex, queries: DataFrame, scores: DataFrame) -> DataFrame:
    """qid, chunk_id, score, lexical_rank, lexical_ref (largest score) from the BM25 scores. Passages without a hit fill the
    list in their order."""
    limit = queries.select("qid", F.greatest(F.lit(LEAST_DEPTH), DEPTH * F.col("top_k")).alias("m"))
    # Only the first m passages by id can fill the list, so the others need no zero row.
    most = deepest(queries)
    fill = index.chunks.select("chunk_id").orderBy("chunk_id").limit(most)
    zeros = fill.crossJoin(limit.select("qid")).join(scores, ["qid", "chunk_id"], "left_anti").select("qid", "chunk_id", F.lit(0.0).alias("score"))
    every = scores.unionByName(zeros)
    ranked = every.withColumn("lexical_rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "chunk_id"))).where(F.col("lexical_rank") <= most)
    first = ranked.where("lexical_rank = 1").select("qid", F.col("score").alias("lexical_ref"))
    return ranked.join(limit, "qid").where(F.col("lexical_rank") <= F.col("m")).drop("m").join(first, "qid")


def exact_chunks(index: SearchIndex, queries: DataFrame) -> DataFrame:
    """qid, chunk_id, phrase, exact, injectable of the passages with an exact match: one scan for the whole batch. A query
    without terms matches every passage; only those it holds as a phrase are listed, `fuse` knows the rest."""
    q = queries.select("qid", F.lower("query").alias("q"), query_terms("query").alias("terms"))
    low = index.chunks.select("chunk_id", F.lower("text").alias("low"))
    phrase = F.contains("low", F.col("q"))
    terms = contains_all_terms(F.col("low"), F.col("terms")) & (F.size("terms") > 0)
    return low.crossJoin(q).where(phrase | terms).select("qid", "chunk_id", phrase.alias("phrase"), F.lit(True).alias("injectable"))


def fuse(index: SearchIndex, queries: DataFrame, dense: DataFrame, lexical: DataFrame, scores: DataFrame, n_chunks: int) -> DataFrame:
    """qid, chunk_id, value, cosine, lex (score against the best), phrase, exact, pass (1 for injected ones)."""
    exact = exact_chunks(index, queries).withColumn("exact", F.lit(True))
    everything = queries.select("qid", (F.size(query_terms("query")) == 0).alias("all_exact"))
    rr = lambda c: F.coalesce(1.0 / (RRF_K + F.col(c)), F.lit(0.0))
    both = dense.join(lexical.drop("lexical_ref"), ["qid", "chunk_id"], "full_outer").join(exact, ["qid", "chunk_id"], "left").join(everything, "qid")
    hit = F.coalesce("exact", F.lit(False)) | F.col("all_exact")
    first = both.select("qid", "chunk_id", ((rr("dense_rank") + rr("lexical_rank")) * F.when(hit, CHUNK_BOOST).otherwise(1.0)).alias("value"), F.coalesce("cosine", F.lit(0.0)).alias("cosine"), F.coalesce("phrase", F.lit(False)).alias("phrase"), hit.alias("exact"), F.lit(0).alias("pass"))
    depth = queries.select("qid", F.least(F.lit(n_chunks), F.greatest(F.lit(LEAST_DEPTH), DEPTH * F.col("top_k"))).alias("fetch"))
    more = exact.where("injectable").join(first.select("qid", "chunk_id"), ["qid", "chunk_id"], "left_anti").join(depth, "qid").select("qid", "chunk_id", (CHUNK_BOOST / (RRF_K + F.col("fetch"))).alias("value"), F.lit(0.0).alias("cosine"), "phrase", F.lit(True).alias("exact"), F.lit(1).alias("pass"))
    # BM25 is known for every passage with a hit, not only for the ranked ones.
    top = scores.groupBy("qid").agg(F.max("score").alias("ref"))
    lex = scores.join(top, "qid").select("qid", "chunk_id", F.when(F.col("ref") > 0, F.col("score") / F.col("ref")).otherwise(0.0).alias("lex"))
    return first.unionByName(more).join(lex, ["qid", "chunk_id"], "left").withColumn("lex", F.coalesce("lex", F.lit(0.0)))


def rank_documents(index: SearchIndex, queries: DataFrame, fused: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """qid, rank, relative_path, file_name, file_type, score, aggregated, relevance, chunk_id of the representative passage."""
    doc = index.chunks.select("chunk_id", "relative_path", "file_name", "file_type", "category")
    items = fused.join(doc, "chunk_id").withColumn("ord", F.struct("pass", "chunk_id"))
    per = Window.partitionBy("qid", "relative_path")
    items = items.withColumn("rn", F.row_number().over(per.orderBy(F.desc("value"), "ord")))
    items = items.withColumns({
        "doc_exact": F.max("exact").over(per), "exact_on_top": F.max(F.col("exact") & (F.col("rn") <= BEST)).over(per),
        "phrase_rn": F.min(F.when(F.col("phrase"), F.col("rn"))).over(per), "first_ord": F.min("ord").over(per),
    })
    kept = items.where((F.col("rn") <= BEST) | (F.col("doc_exact") & ~F.col("exact_on_top") & (F.col("rn") == F.col("phrase_rn"))))
    docs = kept.groupBy("qid", "relative_path").agg(
        F.first("file_name").alias("file_name"), F.first("file_type").alias("file_type"), F.first("category").alias("cat"), F.first("doc_exact").alias("doc_exact"), F.first("first_ord").alias("first_ord"),
        F.avg("value").alias("mean"), F.max("cosine").alias("score"), F.max("lex").alias("best_lex"), F.min(F.when(F.col("rn") == 1, F.col("chunk_id"))).alias("chunk_id"),
    )
    any_lex = fused.groupBy("qid").agg((F.max("lex") > 0).alias("has_lex"))
    docs = docs.join(queries.select("qid", "top_k", "category", F.col("file_type").alias("only_type")), "qid").join(any_lex, "qid")
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    dense = clamp((F.col("score") - COSINE_LOW) / COSINE_RANGE)
    relevance = 100 * F.when(F.col("has_lex"), (dense + clamp(F.col("best_lex"))) / 2).otherwise(dense)
    docs = docs.withColumn("relevance", F.when(F.col("doc_exact"), F.greatest(relevance, F.lit(FLOOR))).otherwise(relevance)).withColumn("aggregated", F.when(F.col("doc_exact"), F.col("mean") * DOCUMENT_BOOST).otherwise(F.col("mean")))
    passed = docs.where((F.col("doc_exact") | (F.col("score") >= threshold)) & (F.col("only_type").isNull() | (F.col("only_type") == F.col("file_type"))) & (F.col("category").isNull() | (F.col("category") == F.col("cat"))))
    order = Window.partitionBy("qid").orderBy(F.desc(F.round("aggregated", 12)), "first_ord")
    ranked = passed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= F.col("top_k"))
    return ranked.select("qid", "rank", "relative_path", "file_name", "file_type", F.col("cat").alias("category"), "score", "aggregated", "relevance", "chunk_id")


def hybrid_search(index: SearchIndex, queries: DataFrame, vectors: list[tuple[int, list[float]]], threshold: float = THRESHOLD) -> DataFrame:
    """Ranked documents with a preview, for every query of the batch. `queries` is a small driver-made table; so are the vectors."""
    n = index.lexical.corpus_stats.first()["n"]
    # Both are read several times below and are of the size of the candidates, so they are written once.
    scores = write_shared(bm25_scores(index.lexical, queries), "scores")
    fused = write_shared(fuse(index, queries, dense_ranks(index, queries, vectors), lexical_ranks(index, queries, scores), scores, n), "fused")
    found = rank_documents(index, queries, fused, threshold)
    texts = index.chunks.select("chunk_id", "text").join(found, "chunk_id").join(queries.select("qid", "query"), "qid")
    return texts.withColumn("text_preview", text_preview("text", query_terms("query"))).drop("text", "query", "chunk_id")


def suggestion_queries(terms: list[str], start: int = 0) -> list[tuple[int, str]]:
    """Each term alone, then each pair of them, as a batch for one search."""
    pairs = [f"{a} {b}" for i, a in enumerate(terms) for b in terms[i + 1 :]]
    return list(enumerate([*terms, *pairs], start))


def suggestions(ranked: DataFrame, queries: DataFrame, top: int = 3) -> DataFrame:
    """term, file_name, relative_path, score: the first result of each query, the best three by cosine."""
    first = ranked.where("rank = 1").join(queries.select("qid", F.col("query").alias("term")), "qid")
    best = first.withColumn("n", F.row_number().over(Window.partitionBy("term").orderBy(F.desc("score"), "qid"))).where("n = 1")
    return best.orderBy(F.desc("score"), "qid").limit(top).select("term", "file_name", "relative_path", "score")
