"""Write-ahead log files: header, frames by ranges in parallel, checksums, committed pages."""

from __future__ import annotations

import struct
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from logfold import model
from logfold.functions.checksum import checksum
from logfold.operators import ordered

# Fixed values of the public file format.
MAGIC = 0x377F0682
HEADER, FRAME_HEADER = 32, 24
VERSION = 3007000
FIELDS = ("magic", "version", "page_size", "checkpoint_seq", "salt1", "salt2", "ck1", "ck2")
#: Frames in one partition of a scan.
RANGE = 4096


def open_input(path: str):
    """A random-access file, local or in a store that Arrow reads."""
    from pyarrow import fs

    at, inside = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return at.open_input_file(inside)


def decode_header(raw: bytes) -> dict[str, int]:
    if len(raw) < HEADER:
        raise ValueError("log header is short")
    h = dict(zip(FIELDS, struct.unpack(">8I", raw[:HEADER])))
    if h["magic"] & ~1 != MAGIC:
        raise ValueError("not a write-ahead log")
    return h


def encode_header(page_size: int, salt1: int, salt2: int, checkpoint_seq: int = 0, big_endian: bool = False) -> bytes:
    body = struct.pack(">6I", MAGIC | big_endian, VERSION, page_size, checkpoint_seq, salt1, salt2)
    return body + struct.pack(">2I", *checksum(body, big_endian=big_endian))


def encode_frame(pg_no: int, n_truncate: int, salt1: int, salt2: int, data: bytes, seed: tuple[int, int], big_endian: bool = False) -> bytes:
    """A frame whose checksum goes on from the frame before it."""
    head = struct.pack(">2I", pg_no, n_truncate)
    return head + struct.pack(">4I", salt1, salt2, *checksum(head + data, seed, big_endian)) + data


def classify_offset(offset: int, page_size: int) -> str:
    """What a write at an offset of the log is: header, frame_header or frame_data."""
    if offset == 0:
        return "header"
    at = (offset - HEADER) % (FRAME_HEADER + page_size)
    if offset < HEADER or at not in (0, FRAME_HEADER):
        raise ValueError(f"offset {offset} is neither a frame's header nor its data")
    return "frame_header" if at == 0 else "frame_data"


class _Range(InputPartition):
    def __init__(self, first: int, last: int, page_size: int):
        self.first, self.last, self.page_size = first, last, page_size


class _Reader(DataSourceReader):
    def __init__(self, path: str, frames: int):
        self.path, self.frames = path, frames

    def partitions(self) -> list[InputPartition]:
        with open_input(self.path) as f:
            if f.size() < HEADER:
                return []
            page = decode_header(f.read_at(HEADER, 0))["page_size"]
            n = (f.size() - HEADER) // (FRAME_HEADER + page)  # a partial frame at the end is no frame
        return [_Range(a, min(a + self.frames, n), page) for a in range(0, n, self.frames)]

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        stride = FRAME_HEADER + part.page_size
        with open_input(self.path) as f:
            for a in range(part.first, part.last, 256):
                b = min(a + 256, part.last)
                raw = f.read_at((b - a) * stride, HEADER + a * stride)
                heads = [struct.unpack_from(">6I", raw, k * stride) for k in range(b - a)]
                columns = [pa.array(range(a + 1, b + 1), pa.int64()), *(pa.array([h[j] for h in heads], pa.int64()) for j in range(6))]
                data = pa.array([raw[k * stride + FRAME_HEADER : (k + 1) * stride] for k in range(b - a)], pa.binary())
                yield pa.RecordBatch.from_arrays([*columns, data], names=["frame_no", "pg_no", "n_truncate", "salt1", "salt2", "ck1", "ck2", "data"])


class WalSource(DataSource):
    """spark.read.format("wal").load(path): a row per whole frame, a partition per range of frames."""

    @classmethod
    def name(cls) -> str:
        return "wal"

    def schema(self) -> str:
        return model.FRAME_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("framesperpartition", RANGE)))


def frames(spark: SparkSession, path: str, frames_per_partition: int = RANGE) -> DataFrame:
    """Whole frames; bytes behind the last one are warned of."""
    with open_input(path) as f:
        if f.size() >= HEADER:
            rest = (f.size() - HEADER) % (FRAME_HEADER + decode_header(f.read_at(HEADER, 0))["page_size"])
            if rest:
                warnings.warn(f"{path}: {rest} bytes behind the last whole frame are left out", stacklevel=2)
    spark.dataSource.register(WalSource)
    return spark.read.format("wal").option("framesPerPartition", frames_per_partition).load(path)


def header(path: str) -> dict[str, int]:
    with open_input(path) as f:
        return decode_header(f.read_at(min(HEADER, f.size()), 0))


def valid_frames(all_frames: DataFrame, head: dict[str, int], width: int = ordered.SEGMENT) -> DataFrame:
    """The frames before the first whose salts or chained checksum fail. Each frame is checked against the checksum stored
    in the frame before it, so frames are checked in parallel."""
    big = bool(head["magic"] & 1)
    seed = F.lit(head["ck1"]).cast("long"), F.lit(head["ck2"]).cast("long")
    before = all_frames.select((F.col("frame_no") + 1).alias("frame_no"), F.col("ck1").alias("p1"), F.col("ck2").alias("p2"))
    chained = all_frames.join(before, "frame_no", "left").withColumns({"p1": F.coalesce("p1", seed[0]), "p2": F.coalesce("p2", seed[1])})

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bad = []
            for no, pg, nt, s1, s2, c1, c2, data, p1, p2 in zip(*(batch.column(c).to_pylist() for c in ("frame_no", "pg_no", "n_truncate", "salt1", "salt2", "ck1", "ck2", "data", "p1", "p2"))):
                if (s1, s2) != (head["salt1"], head["salt2"]) or checksum(struct.pack(">2I", pg, nt) + data, (p1, p2), big) != (c1, c2):
                    bad.append(no)
            if bad:
                yield pa.RecordBatch.from_pydict({"frame_no": pa.array(bad, pa.int64())})

    first_bad = chained.mapInArrow(check, "frame_no long").agg(F.coalesce(F.min("frame_no"), F.lit(2**62)).alias("_bad"))
    return all_frames.join(F.broadcast(first_bad), F.col("frame_no") < F.col("_bad")).drop("_bad")  # one row


def committed_pages(valid: DataFrame) -> DataFrame:
    """pg_no and data after the last commit frame: last writer wins, cut to the size that the last commit left."""
    end = valid.where("n_truncate <> 0").agg(F.max("frame_no").alias("_end"), F.max_by("n_truncate", "frame_no").alias("_size"))
    upto = valid.join(F.broadcast(end), F.col("frame_no") <= F.col("_end"))  # one row
    return upto.where("pg_no <= _size").groupBy("pg_no").agg(F.max_by("data", "frame_no").alias("data"))
