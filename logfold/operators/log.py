"""The log's own operators: bounds, gaps, merge, as-of reads, transactions, admission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from logfold.operators import ordered


def bounds(df: DataFrame, idx: str) -> DataFrame:
    """first_index and last_index, both 0 for an empty log."""
    return df.agg(F.coalesce(F.min(idx), F.lit(0)).cast("long").alias("first_index"), F.coalesce(F.max(idx), F.lit(0)).cast("long").alias("last_index"))


def point(df: DataFrame, idx: str, at: int) -> DataFrame:
    return df.where(F.col(idx) == at)


def gaps(df: DataFrame, idx: str, width: int = ordered.SEGMENT) -> DataFrame:
    """gap_start and gap_end, both inclusive, of every run of missing indexes between the bounds."""
    prev = ordered.previous(df.select(idx), idx, "_prev", width)
    return prev.where(F.col(idx) > F.col("_prev") + 1).select((F.col("_prev") + 1).alias("gap_start"), (F.col(idx) - 1).alias("gap_end"))


def delete_range(df: DataFrame, idx: str, first: int, last: int) -> DataFrame:
    """Rows outside the range; both ends belong to it."""
    return df.where(~F.col(idx).between(first, last))


def merge(df: DataFrame, key: str, order: str, *values: str) -> DataFrame:
    """Last writer wins per key. max_by aggregates on the map side, so a hot key costs one row per task."""
    return df.groupBy(key).agg(*[F.max_by(v, order).alias(v) for v in values], F.max(order).alias(order))


def as_of(df: DataFrame, key: str, order: str, version: int, *values: str) -> DataFrame:
    """The merge of the log up to a version; the bound is pushed into the scan."""
    return merge(df.where(F.col(order) <= version), key, order, *values)


def merge_truncate(df: DataFrame, key: str, order: str, version: int, size: int, *values: str) -> DataFrame:
    """The merge up to a version, then without the keys beyond the size after its last commit."""
    return as_of(df, key, order, version, *values).where(F.col(key) <= size)


def superseded(df: DataFrame, key: str, order: str, version: int) -> DataFrame:
    """Rows up to a version that a later one of their key replaces there: what compaction may drop."""
    upto = df.where(F.col(order) <= version)
    newest = upto.groupBy(key).agg(F.max(order).alias("_newest"))
    return upto.join(newest, key).where(F.col(order) < F.col("_newest")).drop("_newest")


def dedupe(df: DataFrame, entry: str, idx: str) -> DataFrame:
    """Each entry id once, at its first index: replayed entries count for nothing."""
    return df.groupBy(entry).agg(F.min(idx).alias(idx))


def transactions(df: DataFrame, order: str, commit: Column, name: str = "txn", width: int = ordered.SEGMENT) -> DataFrame:
    """Adds each frame's transaction number: the commits strictly before it."""
    return ordered.running_sum_before(df.withColumn("is_commit", commit.cast("int")), order, F.col("is_commit"), name, width)


def uncommitted(df: DataFrame, idx: str, is_commit: Column) -> DataFrame:
    """The rows behind the last commit: one number and a filter."""
    last = df.where(is_commit).agg(F.max(idx).alias("_last"))
    return df.join(F.broadcast(last), F.col(idx) > F.coalesce(F.col("_last"), F.lit(-(2**63)))).drop("_last")


def committed(frames: DataFrame) -> DataFrame:
    """txn, pages and commit_frame of transactions that reached their commit frame."""
    found = frames.groupBy("txn").agg(F.count(F.lit(1)).alias("pages"), F.max("event_id").alias("commit_frame"), F.max("is_commit").alias("_done"))
    return found.where("_done = 1").drop("_done")


def base_check(df: DataFrame, idx: str, base: Column, width: int = ordered.SEGMENT) -> DataFrame:
    """status of every request: OK where its base is the index applied just before it, else STALE_BASE."""
    return ordered.previous(df, idx, "applied", width).withColumn("status", F.when(base.eqNullSafe(F.col("applied")), "OK").otherwise("STALE_BASE"))


#: What a caller sees for each response status.
OUTCOMES = {
    "OK": ("OK", False),
    "STALE_BASE": ("BUSY", True),
    "CATCHING_UP": ("BUSY", True),
    "BUSY": ("BUSY", True),
    "NOT_LEADER": ("READONLY", True),
    "INVALID": ("IOERR_WRITE", False),
    "AMBIGUOUS": ("IOERR_WRITE", False),
}


def outcomes(df: DataFrame, status: str) -> DataFrame:
    """Adds code and safe_to_retry; unknown statuses are ambiguous."""
    code, safe = F.lit("IOERR_WRITE"), F.lit(False)
    for k, (c, s) in OUTCOMES.items():
        code, safe = F.when(F.col(status) == k, c).otherwise(code), F.when(F.col(status) == k, s).otherwise(safe)
    return df.withColumn("code", code).withColumn("safe_to_retry", safe)


def version_diff(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Keys that differ between two versions: only_a, only_b or differ."""
    x, y = a.select(key, F.col(value).alias("a_value"), F.lit(1).alias("_a")), b.select(key, F.col(value).alias("b_value"), F.lit(1).alias("_b"))
    both = x.join(y, key, "full_outer")
    status = F.when(F.col("_b").isNull(), "only_a").when(F.col("_a").isNull(), "only_b").when(~F.col("a_value").eqNullSafe(F.col("b_value")), "differ")
    return both.select(key, "a_value", "b_value", status.alias("status")).where("status is not null")


def digest(df: DataFrame, group: str | None, item: Column, order: str, name: str = "digest") -> DataFrame:
    """Ordered concatenation of items, an empty text for no rows."""
    text = F.coalesce(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), item.alias("i")))), lambda x: x["i"]), "|"), F.lit(""))
    return (df.groupBy(group) if group else df.groupBy()).agg(text.alias(name))


def per_key(key: str, order: str) -> Window:
    return Window.partitionBy(key).orderBy(order)
