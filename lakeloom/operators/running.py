"""Running sums over groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(rows: DataFrame, group: list[str], reach: Column, order: list[str], value: str) -> DataFrame:
    """``rows`` with ``before``: the sum of ``value`` over the rows of the group that stand before, ordered by ``reach`` and ``order``.

    The sums of the ranges (rows of equal ``reach``) come first, then those inside a range, so a group is spread over tasks.
    """
    own = rows.withColumn("reach", reach)
    sums = own.groupBy(*group, "reach").agg(F.sum(value).alias("_sum"))
    sums = sums.select(*group, "reach", (F.sum("_sum").over(Window.partitionBy(*group).orderBy("reach")) - F.col("_sum")).alias("_before"))
    inside = F.sum(value).over(Window.partitionBy(*group, "reach").orderBy(*order)) - F.col(value)
    return own.withColumn("_inside", inside).join(sums, [*group, "reach"]).withColumn("before", F.col("_before") + F.col("_inside")).drop("_before", "_inside", "reach")
