"""Enough tasks for costly work on few, small files."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """`df` with its rows dealt out evenly if it is smaller than one least split a core, else as it is.

    A scan cuts files no finer than `spark.sql.files.openCostInBytes` (4 MB), so a smaller table leaves cores idle; only
    such a table is shuffled, by the size of its files, whatever columns are taken. The plan is looked at, not run.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    least = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.openCostInBytes", "4194304"))
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size()))
    return df.repartition(cores) if size < least * cores else df
