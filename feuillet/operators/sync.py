"""Incremental synchronisation of a folder, its index and the catalogue, as set and join operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feuillet.functions.text import category_of


def reuse_hashes(scan: DataFrame, catalogue: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of the scan with the stored hash where the stored modification time is the same, paths still to be hashed).
    Only the second needs the files' content."""
    old = catalogue.select("relative_path", F.col("modified_at").alias("old_at"), F.col("content_hash").alias("old_hash"))
    joined = scan.drop("content_hash").join(old, "relative_path", "left")
    same = (F.col("modified_at") == F.col("old_at")) & F.col("old_hash").isNotNull()
    kept = joined.where(same).withColumn("content_hash", F.col("old_hash")).drop("old_at", "old_hash")
    todo = joined.where(~F.coalesce(same, F.lit(False))).drop("old_at", "old_hash")
    return kept, todo


def detect_changes(scan: DataFrame, catalogue: DataFrame) -> DataFrame:
    """relative_path, change_type (added, updated, deleted): one full outer join on the path."""
    new, old = scan.select("relative_path", F.col("content_hash").alias("new_hash"), F.lit(1).alias("is_new")), catalogue.select("relative_path", F.col("content_hash").alias("old_hash"), F.lit(1).alias("is_old"))
    both = new.join(old, "relative_path", "full_outer")
    kind = F.when(F.col("is_old").isNull(), "added").when(F.col("is_new").isNull(), "deleted").when(~F.col("new_hash").eqNullSafe(F.col("old_hash")), "updated")
    return both.select("relative_path", kind.alias("change_type")).where("change_type is not null")


def affected_categories(changes: DataFrame) -> DataFrame:
    return changes.select(category_of("relative_path").alias("category")).distinct()


def touched(changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(paths whose passages go: deleted and updated ones, paths to be read: added and updated ones)."""
    of = lambda *kinds: changes.where(F.col("change_type").isin(*kinds)).select("relative_path").distinct()
    return of("deleted", "updated"), of("added", "updated")


def upsert(catalogue: DataFrame, incoming: DataFrame, key: str = "relative_path", keep: tuple[str, ...] = ("id", "created_at")) -> DataFrame:
    """The catalogue with the incoming rows inserted or their values put over the old ones; columns of `keep` stay as stored."""
    columns = catalogue.columns
    new = incoming.select(*(F.col(c).alias(f"n_{c}") for c in incoming.columns), F.lit(1).alias("__new"))
    both = catalogue.withColumn("__old", F.lit(1)).join(new, F.col(key) == F.col(f"n_{key}"), "full_outer")

    def pick(c: str) -> Column:
        if c not in incoming.columns:
            return F.col(c)
        if c in keep:
            return F.when(F.col("__old").isNotNull(), F.col(c)).otherwise(F.col(f"n_{c}")).alias(c)
        return F.when(F.col("__new").isNotNull(), F.col(f"n_{c}")).otherwise(F.col(c)).alias(c)

    return both.select(*(pick(c) for c in columns))


def delete_not_in(catalogue: DataFrame, current: DataFrame, key: str = "relative_path") -> DataFrame:
    """The catalogue without the paths that are gone; with no current path at all nothing is deleted."""
    if current.isEmpty():
        return catalogue
    return catalogue.join(current.select(key).distinct(), key, "left_semi")


def first_of_content(df: DataFrame, hash_col: str = "content_hash", key: str = "id") -> DataFrame:
    """For each hash the smallest key and the number of rows, so that equal contents are extracted once."""
    return df.where(F.col(hash_col).isNotNull()).groupBy(hash_col).agg(F.min(key).alias("first_id"), F.count("*").alias("copies"))


def rebuild_chunks(old_chunks: DataFrame, changes: DataFrame, fresh_chunks: DataFrame) -> DataFrame:
    """Passages after a change: old ones of untouched files with their vectors, new ones of added and updated files."""
    removed, changed = touched(changes)
    return old_chunks.join(removed, "relative_path", "left_anti").unionByName(fresh_chunks.join(changed, "relative_path", "left_semi"), allowMissingColumns=True)


def shard_offsets(chunks: DataFrame) -> DataFrame:
    """category, n, start: where the passages of a category begin in the order of all. The window is over the few categories."""
    sizes = chunks.groupBy("category").agg(F.count("*").alias("n"))
    before = Window.orderBy("category").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))


def misaligned(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Categories whose stored passages (relative_path, chunk_no) are not those cut now; such an index must be rebuilt."""
    a, b = stored.select("category", "relative_path", "chunk_no").distinct(), fresh.select("category", "relative_path", "chunk_no").distinct()
    both = a.withColumn("x", F.lit(1)).join(b.withColumn("y", F.lit(1)), ["category", "relative_path", "chunk_no"], "full_outer")
    return both.groupBy("category").agg(F.count_if(F.col("y").isNull()).alias("gone"), F.count_if(F.col("x").isNull()).alias("missing"))


def ordered_distinct(df: DataFrame, value: str, position: str) -> DataFrame:
    """Each value with its first position."""
    return df.groupBy(value).agg(F.min(position).alias("first_position"))
