"""Global row numbers without a single sorting task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boardwright.session import cut


def numbered(df: DataFrame, order: Sequence, name: str, first: int = 0) -> DataFrame:
    """df with `name`: its place in `order`, from `first` on. Rows are range-sorted and numbered within their partitions;
    only one row count per partition is put in order by one task. `order` should end in a unique column."""
    at = F.monotonically_increasing_id()
    rows = cut(df.orderBy(*order).withColumn("__p", F.spark_partition_id()).withColumn("__m", at.bitwiseAND(F.lit((1 << 33) - 1))))
    counts = rows.groupBy("__p").agg(F.count("*").alias("__n"))
    base = counts.select("__p", (F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).alias("__base"))
    # as many rows as partitions
    return rows.join(F.broadcast(base), "__p").withColumn(name, F.col("__base") + F.col("__m") + first).drop("__p", "__m", "__base")
