"""Consecutive numbers in a global order, without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feuillet.plans.shared import write_shared


def number_rows(df: DataFrame, order: list[str], name: str = "row_no") -> DataFrame:
    """`df` with 1..n in the given order. Rows are range-partitioned and sorted, written once, and numbered by the offsets
    of their partitions; only one count a partition is broadcast."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = placed.withColumn("__at", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__at", 33))
    placed = write_shared(placed, "numbered")
    sizes = placed.groupBy("__part").agg(F.count("*").alias("__n"))
    # One row a partition, so the running sum is over a few thousand rows at most.
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    place = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + place + 1).drop("__at", "__part", "__before")
