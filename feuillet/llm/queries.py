"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feuillet.llm import ann, leak, mixture, mojibake, neardup, ocr, residue, split
from feuillet.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Files whose text was read in a wrong encoding."""
    return mojibake.repair_encoding(table(spark, d, "ged_documents")).select("id")


def p1_repaired(spark: SparkSession, d: str) -> DataFrame:
    """Their repaired texts."""
    return mojibake.repair_encoding(table(spark, d, "ged_documents"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of files with a similarity of at least 0.6 on three words."""
    return neardup.similar_pairs(table(spark, d, "ged_documents"), 0.6, 3)


def p2_classes(spark: SparkSession, d: str) -> DataFrame:
    """Class of every file, with its number of links to other classes."""
    membership, pairs = neardup.similar_classes(table(spark, d, "ged_documents"), 0.6, 3)
    ends = pairs.select(F.col("class_a").alias("class_id")).union(pairs.select("class_b"))
    return membership.join(ends.groupBy("class_id").agg(F.count("*").alias("links")), "class_id", "left").select("id", "class_id", F.coalesce("links", F.lit(0)).alias("links"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Files whose text has marks of the page image."""
    return ocr.clean_scans(table(spark, d, "ged_documents")).select("id")


def p3_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """Their texts as continuous paragraphs."""
    return ocr.clean_scans(table(spark, d, "ged_documents"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of passages with a cosine of at least 0.75, one of them among the five nearest of the other."""
    near = ann.nearest_vectors(table(spark, d, "shard")).where("cosine >= 0.75")
    return near.select(F.least("chunk_id", "neighbour").alias("chunk_id_a"), F.greatest("chunk_id", "neighbour").alias("chunk_id_b")).distinct()


def p4_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest of every passage."""
    return ann.nearest_vectors(table(spark, d, "shard"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Files whose text had to be cut."""
    return split.split_oversized(table(spark, d, "ged_documents")).where("passage_no = 2").select("id")


def p5_passages(spark: SparkSession, d: str) -> DataFrame:
    """The passages themselves."""
    return split.split_oversized(table(spark, d, "ged_documents"))


def p5_checked(spark: SparkSession, d: str) -> DataFrame:
    """Of every file that was cut: its length, and whether its passages fit, cover it without a gap, and overlap as they should."""
    rows = split.split_oversized(table(spark, d, "ged_documents"))
    near = Window.partitionBy("id").orderBy("passage_no")
    before = F.lag("end").over(near)
    rows = rows.withColumn("joined", before.isNull() & (F.col("start") == 0) | (F.col("start") <= before) & (before - F.col("start") <= 150) & (F.col("start") > F.lag("start").over(near)))
    fits = (F.length("passage") <= 900) & (F.length("passage") == F.col("end") - F.col("start"))
    return rows.groupBy("id").agg(F.max("end").cast("long").alias("chars"), F.bool_and(fits).alias("fits"), F.bool_and("joined").alias("covers"), (F.max("passage_no") == F.count("*")).alias("numbered"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Texts and items with at least 13 consecutive words in common."""
    return leak.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_passages")).where("longest_run >= 13").select("doc_id", "item_id").distinct()


def p6_alignments(spark: SparkSession, d: str) -> DataFrame:
    """All leaks, edited copies included, with their alignment."""
    return leak.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_passages"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Sources that cannot reach their share."""
    return mixture.unreachable_sources(table(spark, d, "documents"), table(spark, d, "source_targets"))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    """Wanted and reached shares of the drawn corpus."""
    return mixture.mixture_report(table(spark, d, "documents"), table(spark, d, "source_targets"))


def p7_sample(spark: SparkSession, d: str) -> DataFrame:
    """The drawn rows with their number of copies."""
    return mixture.mix_sources(table(spark, d, "documents"), table(spark, d, "source_targets"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Texts that are template residue, filler or error pages."""
    return residue.classify_residue(table(spark, d, "documents")).select("doc_id")


def p8_clean(spark: SparkSession, d: str) -> DataFrame:
    """The corpus without them."""
    return residue.without_residue(table(spark, d, "documents")).select("doc_id", "lang", "source", "text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1:2].isdigit() and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": r"""
            WITH t AS (SELECT id, regexp_extract_all(lower(coalesce(file_name, '') || ' ' || coalesce(extracted_text, '')), '[\p{L}\p{N}]+') AS w FROM ged_documents),
            g AS (SELECT DISTINCT id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS i FROM t WHERE len(w) >= 3)),
            n AS (SELECT id, count(*) AS n FROM g GROUP BY 1),
            c AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.id < b.id GROUP BY 1, 2)
            SELECT id_a, id_b FROM c JOIN n x ON x.id = id_a JOIN n y ON y.id = id_b WHERE c >= 0.6 * (x.n + y.n - c)""",
        "p5_found": r"SELECT id FROM ged_documents WHERE length(trim(extracted_text, chr(32) || chr(9) || chr(13) || chr(10))) > 900",
        "p5_checked": r"SELECT id, length(trim(extracted_text, chr(32) || chr(9) || chr(13) || chr(10))) AS chars, TRUE AS fits, TRUE AS covers, TRUE AS numbered FROM ged_documents WHERE length(trim(extracted_text, chr(32) || chr(9) || chr(13) || chr(10))) > 900",
        "p7_found": """
            WITH t AS (SELECT sum(coalesce(strlen(text), 0)) AS n FROM documents),
            s AS (SELECT lower(trim(source)) AS source, sum(coalesce(strlen(text), 0)) AS size FROM documents GROUP BY 1)
            SELECT g.source FROM source_targets g CROSS JOIN t LEFT JOIN s ON s.source = g.source
            WHERE g.target_share * t.n > g.max_repeats * coalesce(s.size, 0)""",
    }
