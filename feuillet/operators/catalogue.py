"""Queries on the catalogue, accounts and the search history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feuillet.functions.text import category_of


def page(df: DataFrame, limit: int | None = None, offset: int = 0, key: str = "id") -> DataFrame:
    """Without a limit all rows by ascending key (the offset counts for nothing); with one, a page by descending key."""
    if limit is None:
        return df.orderBy(key)
    return df.orderBy(F.desc(key)).offset(offset).limit(limit)


def latest(df: DataFrame, n: int = 5, key: str = "id") -> DataFrame:
    return df.orderBy(F.desc(key)).limit(n)


def category_counts(df: DataFrame) -> DataFrame:
    return df.groupBy(category_of("relative_path").alias("category")).agg(F.count("*").alias("n"))


def grouped_listing(df: DataFrame, category: str | None = None) -> DataFrame:
    """Files with their category, one category or all, in the order of category and id."""
    rows = df.withColumn("category", category_of("relative_path"))
    return (rows if category is None else rows.where(F.col("category") == category)).orderBy("category", "id")


def first_of_groups(df: DataFrame, visible: int = 30) -> DataFrame:
    """The first `visible` files over the sorted categories. Sort and limit, so only `visible` rows meet in one task."""
    return df.withColumn("category", category_of("relative_path")).orderBy("category", "id").limit(visible)


def sessions_of_users(sessions: DataFrame, users: DataFrame, at: Column) -> DataFrame:
    """Live sessions (each id once) joined with their users."""
    live = sessions.dropDuplicates(["id"]).where(F.col("expires_at") >= at)
    return live.select(F.col("id").alias("session_id"), "user_id", "token_hash", "expires_at").join(users.select(F.col("id").alias("user_id"), "email", "is_email_verified"), "user_id")


def expired(sessions: DataFrame, at: Column) -> DataFrame:
    return sessions.where(F.col("expires_at") < at)


def cascade_delete(children: DataFrame, deleted_parents: DataFrame, key: str) -> DataFrame:
    return children.join(deleted_parents.select(key), key, "left_anti")


def recent_searches(history: DataFrame, keep: int = 20) -> DataFrame:
    """Newest first, the newest of each (query, top_k), `keep` of them. The newest is kept by a combined aggregate, so that
    a query with a tenth of the rows is reduced before the shuffle."""
    newest = history.groupBy("query", "top_k").agg(F.max_by(F.struct("history_id", "searched_at"), F.struct("searched_at", "history_id")).alias("m"))
    return newest.select("query", "top_k", "m.history_id", "m.searched_at").orderBy(F.desc("searched_at"), F.desc("history_id")).limit(keep)


def relative_scores(ranked: DataFrame, by: str = "qid", score: str = "aggregated") -> DataFrame:
    """Scores as a percentage of the best of their query, one decimal."""
    best = F.max(score).over(Window.partitionBy(by))
    return ranked.withColumn("relative", F.when(best > 0, F.round(F.col(score) / best * 1000) / 10).otherwise(0.0))
