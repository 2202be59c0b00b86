"""The log as a stream: entries applied to a table in index order, each once, whatever is delivered twice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from logfold.model import InvalidChangeError
from logfold.operators import log
from logfold.table import Table


class GapError(InvalidChangeError):
    """Indexes are missing between what was applied and what came."""


def apply_batch(table: Table, batch: DataFrame, batch_id: int, idx: str = "idx", refuse_gaps: bool = True) -> int:
    """Applies one batch of changes (the table's columns, op U or D, idx) and returns the version after it.

    Repeated entries of a batch are one. The batch is one commit, named by its id and last index, so a batch that is run
    again changes nothing. Without gaps, entries at or below the applied index are replays and count for nothing. Where gaps
    are let pass an entry may come after later ones were applied: such entries are not applied, as their base is stale, but
    kept in the table's late() rows, replays among them.
    """
    m = table.manifest()
    if not refuse_gaps:
        late = batch.where(F.col(idx) <= m.last_index).dropDuplicates([idx])
        if not late.isEmpty():
            late.withColumns({"status": F.lit("STALE_BASE"), "batch_id": F.lit(batch_id)}).write.mode("append").parquet(f"{table.path}/_late")
    new = batch.where(F.col(idx) > m.last_index).dropDuplicates([idx])
    ends = new.agg(F.min(idx), F.max(idx), F.count(F.lit(1))).first()
    if not ends[2]:
        return m.version
    if refuse_gaps and (ends[0] != m.last_index + 1 or ends[1] - ends[0] + 1 != ends[2]):
        hole = log.gaps(new, idx).first()
        raise GapError(f"missing {hole.gap_start} to {hole.gap_end}" if hole else f"missing {m.last_index + 1} to {ends[0] - 1}")
    changes = new.withColumnRenamed("op", "_op").withColumn("_seq", F.col(idx)).drop(idx)
    return table.commit(changes, m.version, entry_id=f"batch-{batch_id}-{ends[1]}", index=ends[1])


def late(table: Table) -> DataFrame | None:
    """Entries that came too late, with status and batch, each as often as it came; None if there are none."""
    path = f"{table.path}/_late"
    return table.spark.read.parquet(path) if table.files.names(path) else None


def log_stream(spark: SparkSession, path: str, schema: str, files_a_batch: int = 100) -> DataFrame:
    """Files of log entries as a stream that takes at most so many files at a time, so that a backlog stays bounded work."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def run(table: Table, stream: DataFrame, checkpoint: str, idx: str = "idx", refuse_gaps: bool = True, available_now: bool = True) -> StreamingQuery:
    """Starts applying a stream of changes to a table."""
    writer = stream.writeStream.foreachBatch(lambda batch, k: apply_batch(table, batch, k, idx, refuse_gaps) and None).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def dedupe_stream(stream: DataFrame, entry: str, time: str | None = None, keep: str = "1 hour") -> DataFrame:
    """Each entry id once. With a time column the ids of entries older than keep are forgotten, so state stays bounded."""
    if time is None:
        return stream.dropDuplicates([entry])
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, keep).dropDuplicatesWithinWatermark([entry])
