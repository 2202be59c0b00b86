"""Joins on ranges as equi-joins on bins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def range_join(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str) -> DataFrame:
    """Rows of both where low <= point < high.

    A range is filed under bins as wide as itself, to the next power of two, so under two at most; a point is looked up in
    its bin of every width that occurs, of which there are no more than the exponents of a double. Work grows with points
    times widths and with the matches, whatever the lengths of the ranges. Nulls and empty ranges match nothing.
    """
    exponent = F.ceil(F.log2(F.col(high) - F.col(low))).cast("int")
    filed = ranges.where(F.col(high) > F.col(low)).withColumn("_e", exponent)
    width = F.pow(F.lit(2.0), F.col("_e"))
    bins = F.array_distinct(F.array(F.floor(F.col(low) / width), F.floor(F.col(high) / width)))
    filed = filed.withColumn("_bin", F.explode(bins))
    widths = [r[0] for r in filed.select("_e").distinct().collect()]  # at most the exponents of a double
    if not widths:
        return points.join(ranges, F.lit(False))
    looked = points.where(F.col(point).isNotNull()).withColumn("_e", F.explode(F.array(*[F.lit(e) for e in widths])))
    looked = looked.withColumn("_bin", F.floor(F.col(point) / F.pow(F.lit(2.0), F.col("_e"))))
    met = looked.join(filed, ["_e", "_bin"]).where((F.col(point) >= F.col(low)) & (F.col(point) < F.col(high)))
    return met.drop("_e", "_bin")
