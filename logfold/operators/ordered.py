"""Operators over the whole log's order without gathering the log in one task.

The order column (a log index) is cut into segments of a fixed width. Windows run inside a segment; what crosses segments
is carried by one aggregate row per segment, and only those rows are ever ordered together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

SEGMENT = 1_000_000


def _segmented(df: DataFrame, order: str, width: int) -> DataFrame:
    return df.withColumn("_seg", F.floor(F.col(order) / width))


def _before() -> Window:
    return Window.orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)


def running_sum_before(df: DataFrame, order: str, value: Column, name: str, width: int = SEGMENT) -> DataFrame:
    """Adds the sum of value over all rows strictly before each row in the log's order."""
    seg = _segmented(df, order, width).withColumn("_v", value.cast("long"))
    inside = Window.partitionBy("_seg").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    carry = seg.groupBy("_seg").agg(F.sum("_v").alias("_s")).select("_seg", F.coalesce(F.sum("_s").over(_before()), F.lit(0)).alias("_carry"))
    local = seg.withColumn("_local", F.coalesce(F.sum("_v").over(inside), F.lit(0)))
    return local.join(carry, "_seg").withColumn(name, F.col("_local") + F.col("_carry")).drop("_seg", "_v", "_local", "_carry")


def previous(df: DataFrame, order: str, name: str, width: int = SEGMENT) -> DataFrame:
    """Adds the order value of the row before each row, null for the first."""
    seg = _segmented(df, order, width)
    edge = seg.groupBy("_seg").agg(F.max(order).alias("_m")).select("_seg", F.last("_m", ignorenulls=True).over(_before()).alias("_edge"))
    inside = F.lag(order).over(Window.partitionBy("_seg").orderBy(order))
    return seg.withColumn("_lag", inside).join(edge, "_seg").withColumn(name, F.coalesce("_lag", "_edge")).drop("_seg", "_lag", "_edge")
