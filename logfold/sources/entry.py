"""Log entries on the wire: a small reader and writer of their protobuf fields, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from logfold.model import ENTRY_SCHEMA


def _varint(n: int) -> bytes:
    out = bytearray()
    while True:
        out.append(n & 127 | (128 if n > 127 else 0))
        n >>= 7
        if not n:
            return bytes(out)


def _field(no: int, value: int | bytes) -> bytes:
    if isinstance(value, int):
        return _varint(no << 3) + _varint(value) if value else b""
    return _varint(no << 3 | 2) + _varint(len(value)) + value


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a message."""
    at = 0

    def number() -> int:
        nonlocal at
        n = shift = 0
        while True:
            if at >= len(raw):
                raise ValueError("message ends early")
            b = raw[at]
            at += 1
            n |= (b & 127) << shift
            shift += 7
            if b < 128:
                return n

    while at < len(raw):
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
        elif kind in (1, 2, 5):
            size = {1: 8, 5: 4}.get(kind) or number()
            if at + size > len(raw):
                raise ValueError("message ends early")
            yield tag >> 3, raw[at : at + size]
            at += size
        else:
            raise ValueError(f"bad wire type {kind}")


# Fixed field numbers: entry (1 header, 2 transaction), header (1 id), transaction (1 pages, 2 size), page (1 number, 2 data).
def encode(entry_id: str, pages: list[tuple[int, bytes]], n_truncate: int) -> bytes:
    txn = b"".join(_field(1, _field(1, no) + _field(2, data)) for no, data in pages) + _field(2, n_truncate)
    return _field(1, _field(1, entry_id.encode())) + _field(2, txn)


def decode(raw: bytes) -> dict:
    out: dict = {"id": "", "n_truncate": 0, "pages": []}
    for no, value in fields(raw):
        if no == 1:
            out["id"] = dict(fields(value)).get(1, b"").decode()
        elif no == 2:
            for k, v in fields(value):
                if k == 1:
                    page = dict(fields(v))
                    out["pages"].append({"pg_no": page.get(1, 0), "data": page.get(2, b"")})
                elif k == 2:
                    out["n_truncate"] = v
    return out


def entries(log: DataFrame) -> DataFrame:
    """idx and the decoded entry of every command of a log (type 0); other types carry none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [decode(x) for x in batch.column("data").to_pylist()]
            page = pa.list_(pa.struct([("pg_no", pa.int64()), ("data", pa.binary())]))
            yield pa.RecordBatch.from_arrays([batch.column("idx"), pa.array([g["id"] for g in got]), pa.array([g["n_truncate"] for g in got], pa.int64()), pa.array([g["pages"] for g in got], page)], names=["idx", "id", "n_truncate", "pages"])

    return log.where("type = 0 AND data IS NOT NULL").select("idx", "data").mapInArrow(run, f"idx long, {ENTRY_SCHEMA}")


def problem(entry: dict | None) -> str | None:
    """Why an entry is not a transaction that can be applied; None if it is one."""
    if not entry or not entry["pages"]:
        return "no pages"
    if not entry["n_truncate"]:
        return "no commit"
    if any(not p["pg_no"] or not p["data"] for p in entry["pages"]):
        return "empty page"
    return None
