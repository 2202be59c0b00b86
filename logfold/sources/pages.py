"""Database files as pages: size detection, scan, lookup, diff, hex windows; snapshot streams."""

from __future__ import annotations

import struct
import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from logfold.model import NotFoundError
from logfold.sources.wal import open_input

# A database header's length, the legal page sizes, and the snapshot stream's header.
DB_HEADER = 100
PAGE_SIZES = (512, 1024, 2048, 4096, 8192, 16384, 32768, 65536)
SNAPSHOT_MAGIC, SNAPSHOT_VERSION, SNAPSHOT_HEADER = 0x4C524654, 1, 16


def page_size(raw: bytes) -> int:
    """The page size that a database header states; 1 stands for 65536."""
    if len(raw) < DB_HEADER:
        raise ValueError("database header is short")
    size = struct.unpack_from(">H", raw, 16)[0]
    size = 65536 if size == 1 else size
    if size not in PAGE_SIZES:
        raise ValueError(f"bad page size {size}")
    return size


def pages(spark: SparkSession, path: str, skip: int = 0, per_task: int = 2048) -> DataFrame:
    """pg_no (from 1) and data of every whole page, read in ranges; skip leaves out leading bytes."""
    with open_input(path) as f:
        size = page_size(f.read_at(min(DB_HEADER, max(f.size() - skip, 0)), skip))
        n, rest = divmod(f.size() - skip, size)
    if rest:
        warnings.warn(f"{path}: {rest} bytes behind the last whole page are left out", stacklevel=2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in batch.column(0).to_pylist():
                last = min(first + per_task, n)
                with open_input(path) as g:
                    raw = g.read_at((last - first) * size, skip + first * size)
                yield pa.RecordBatch.from_arrays([pa.array(range(first + 1, last + 1), pa.int64()), pa.array([raw[k : k + size] for k in range(0, len(raw), size)], pa.binary())], names=["pg_no", "data"])

    tasks = -(-n // per_task)
    return spark.range(0, n, per_task, max(1, tasks)).mapInArrow(run, "pg_no long, data binary")


def page_hex(all_pages: DataFrame, pg_no: int) -> str:
    """One page in lower-case hex."""
    row = all_pages.where(F.col("pg_no") == pg_no).select(F.lower(F.hex("data")).alias("h")).first()
    if row is None:
        raise NotFoundError(pg_no)
    return row.h


def hex_window(data: Column, offset: int | Column = 0, width: int = 16) -> Column:
    """Up to width bytes from an offset (from 0) in lower-case hex, cut at the page's end."""
    start = F.lit(offset) if isinstance(offset, int) else offset
    return F.lower(F.hex(F.substring(data, start + 1, F.lit(width))))


def diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """pg_no, status, n_bytes that differ and first_offset of pages that are not the same in both."""
    both = a.select("pg_no", F.col("data").alias("a")).join(b.select("pg_no", F.col("data").alias("b")), "pg_no", "full_outer").where("NOT (a <=> b)")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"pg_no": batch.column("pg_no").to_pylist(), "status": [], "n_bytes": [], "first_offset": []}
            for x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                if x is None or y is None:
                    row = ("only_a" if y is None else "only_b", None, None)
                elif len(x) != len(y):
                    raise ValueError("page sizes differ")
                else:
                    at = np.flatnonzero(np.frombuffer(x, np.uint8) != np.frombuffer(y, np.uint8))
                    row = ("differ", len(at), int(at[0]))
                for name, v in zip(("status", "n_bytes", "first_offset"), row):
                    out[name].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out["pg_no"], pa.int64()), pa.array(out["status"], pa.string()), pa.array(out["n_bytes"], pa.int32()), pa.array(out["first_offset"], pa.int32())], names=list(out))

    return both.mapInArrow(run, "pg_no long, status string, n_bytes int, first_offset int")


def snapshot_header(last_index: int) -> bytes:
    return struct.pack(">IIQ", SNAPSHOT_MAGIC, SNAPSHOT_VERSION, last_index)


def read_snapshot(spark: SparkSession, path: str) -> tuple[int, DataFrame]:
    """The last applied index of a snapshot stream and its pages; malformed streams raise ValueError."""
    with open_input(path) as f:
        size = f.size()
        raw = f.read_at(min(SNAPSHOT_HEADER + DB_HEADER, size), 0)
    if size < SNAPSHOT_HEADER:
        raise ValueError("snapshot header is short")
    magic, version, last = struct.unpack_from(">IIQ", raw)
    if magic != SNAPSHOT_MAGIC or version != SNAPSHOT_VERSION:
        raise ValueError("not a snapshot of this version")
    if (size - SNAPSHOT_HEADER) % page_size(raw[SNAPSHOT_HEADER:]):
        raise ValueError("snapshot ends in a partial page")
    return last, pages(spark, path, skip=SNAPSHOT_HEADER)
