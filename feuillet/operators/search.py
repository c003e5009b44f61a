"""Searches by text: embedding of queries, results kept for a while, suggestions where nothing is found."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row, SparkSession

from feuillet.functions.embedding import embed_query, embed_texts
from feuillet.operators import fusion
from feuillet.plans.cache import ResultCache

QUERY_SCHEMA = "qid long, query string, top_k int, category string, file_type string"


def search_texts(spark: SparkSession, index: fusion.SearchIndex, asked: list[tuple[int, str, int, str | None, str | None]], model: str = "hash-64", threshold: float = fusion.THRESHOLD) -> DataFrame:
    """Ranked documents for a batch of (qid, query, top_k, category, file_type), whose vectors come from the model that made
    those of the index."""
    vectors = embed_texts([a[1] for a in asked], model) if asked else []
    return fusion.hybrid_search(index, spark.createDataFrame(asked, QUERY_SCHEMA), [(a[0], v.tolist()) for a, v in zip(asked, vectors)], threshold)


def suggest(spark: SparkSession, index: fusion.SearchIndex, query: str, model: str = "hash-64", top: int = 3) -> DataFrame:
    """term, file_name, relative_path, score: the first result of each word of the query and of each pair of them, all searched
    as one batch, the best by cosine."""
    asked = [(i, q, 1, None, None) for i, q in fusion.suggestion_queries(query.split())]
    return fusion.suggestions(search_texts(spark, index, asked, model), spark.createDataFrame(asked, QUERY_SCHEMA), top)


@dataclass
class SearchService:
    """One index version, its model and the results kept."""

    spark: SparkSession
    index: fusion.SearchIndex
    version: str
    model: str = "hash-64"
    cache: ResultCache = field(default_factory=ResultCache)

    def search(self, query: str, top_k: int = 5, category: str | None = None, file_type: str | None = None, threshold: float = fusion.THRESHOLD) -> dict[str, list[Row]]:
        """results, and suggestions if there are none. A blank query or a top_k outside 1 to 50 raises ValueError."""
        if not 1 <= top_k <= 50:
            raise ValueError("top_k must be between 1 and 50")
        embed_query(query, self.model)  # refuses a blank one

        def ask() -> dict[str, list[Row]]:
            found = search_texts(self.spark, self.index, [(0, query, top_k, category, file_type)], self.model, threshold).orderBy("rank").collect()
            return {"results": found, "suggestions": [] if found else suggest(self.spark, self.index, query, self.model).collect()}

        return self.cache.fetch(self.cache.key(query, top_k, category, file_type, threshold, self.version), ask)
