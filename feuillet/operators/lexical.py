"""The lexical index (postings, term and corpus statistics) and BM25 over it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feuillet.functions.text import tokenize

K1, B = 1.5, 0.75  # fixed values of the ranking


@dataclass
class LexicalIndex:
    """postings(term, chunk_id, tf, dl), term_stats(term, df, idf), corpus_stats(n, avgdl), one row."""

    postings: DataFrame
    term_stats: DataFrame
    corpus_stats: DataFrame


def tokens_of(chunks: DataFrame, text_col: str = "text") -> DataFrame:
    """chunk_id, toks, dl; passages without tokens are kept."""
    return chunks.select("chunk_id", tokenize(text_col).alias("toks")).withColumn("dl", F.size("toks"))


def term_frequency(tokens: DataFrame) -> DataFrame:
    return tokens.select("chunk_id", "dl", F.explode("toks").alias("term")).groupBy("chunk_id", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def corpus_stats(tokens: DataFrame) -> DataFrame:
    return tokens.agg(F.count("*").alias("n"), (F.coalesce(F.sum("dl"), F.lit(0)) / F.greatest(F.lit(1), F.count("*"))).alias("avgdl"))


def document_frequency(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count("*").alias("df"))


def build_index(chunks: DataFrame, text_col: str = "text") -> LexicalIndex:
    tokens = tokens_of(chunks, text_col)
    postings = term_frequency(tokens)
    corpus = corpus_stats(tokens)
    stats = document_frequency(postings).crossJoin(F.broadcast(corpus)).select("term", "df", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    return LexicalIndex(postings, stats, corpus)


BUCKETS = 16  # parts of stored postings; a search reads those of its terms only


def bucket_of(term: Column | str) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def bucketed(postings: DataFrame) -> DataFrame:
    """Postings laid out to be stored: by bucket of the term, sorted by term, so that scans skip what a search doesn't need.
    They are to be written with `partitionBy("bucket")`."""
    return postings.withColumn("bucket", bucket_of("term")).repartition("bucket").sortWithinPartitions("bucket", "term")


def bm25_scores(index: LexicalIndex, queries: DataFrame) -> DataFrame:
    """qid, chunk_id, score of the passages that hold a token of the query. Each distinct token counts once.

    A batch of queries has few distinct tokens, so those are joined first to the term statistics and the result to the
    postings; of stored postings only the buckets of these tokens are read.
    """
    terms = queries.select("qid", F.explode(F.array_distinct(tokenize("query"))).alias("term"))
    postings = index.postings
    if "bucket" in postings.columns:
        wanted = [r[0] for r in terms.select(bucket_of("term")).distinct().collect()]  # at most BUCKETS
        postings = postings.where(F.col("bucket").isin(wanted)).drop("bucket")
    weighted = terms.join(index.term_stats, "term").crossJoin(F.broadcast(index.corpus_stats))
    tf, dl = F.col("tf"), F.col("dl")
    part = F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.col("avgdl")))
    return postings.join(weighted, "term").groupBy("qid", "chunk_id").agg(F.round(F.sum(part), 9).alias("score"))
