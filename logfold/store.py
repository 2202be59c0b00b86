"""Stores over versioned tables: the log, the stable key-value pairs, and a page image that log entries are applied to."""

from __future__ import annotations

import os
import struct
import threading
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from logfold.model import CommitError, InvalidChangeError, LOG_SCHEMA, NotFoundError, StaleBaseError
from logfold.operators import log
from logfold.sources import entry as wire, pages
from logfold.table import DROP, KEEP, Table


@dataclass(frozen=True)
class Options:
    """Seconds that a writer tries again while the coordinator is busy or catching up, and that it waits for the lease; when
    to compact: after so many changed pages (a negative number: after every commit), or so many seconds after the last time
    if anything changed."""

    forward_timeout: float = 2.0
    lease_timeout: float = 1.0
    compact_pages: int = 1000
    compact_seconds: float = 300.0


class LogStore:
    """Log rows by index."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        self.spark = spark
        try:
            self.table = Table.open(spark, path)
        except NotFoundError:
            self.table = Table.create(spark, path, LOG_SCHEMA, "idx", buckets)

    def bounds(self) -> tuple[int, int]:
        return tuple(log.bounds(self.table.read(), "idx").first())

    def get(self, idx: int) -> dict:
        row = self.table.get(idx)
        if row is None:
            raise NotFoundError(idx)
        return row

    def store(self, rows: list[dict]) -> int:
        """One commit; a row replaces the one of its index."""
        now = time.time_ns()
        values = [(r["idx"], r.get("term", 0), r.get("type", 0), r.get("data"), r.get("extensions"), r.get("appended_at", now)) for r in rows]
        return self.table.upsert(self.spark.createDataFrame(values, LOG_SCHEMA))

    def delete_range(self, first: int, last: int) -> int:
        """Both ends go."""
        return self.table.delete(F.col("idx").between(first, last))

    def scan(self) -> DataFrame:
        """idx, term, type, size and note: every index from the first to the last. A run of missing indexes is one row
        at its start, noted as compacted to its end."""
        rows = self.table.read().select("idx", "term", "type", F.coalesce(F.length("data"), F.lit(0)).cast("long").alias("size"), F.lit(None).cast("string").alias("note"))
        holes = log.gaps(rows, "idx").select(F.col("gap_start").alias("idx"), F.lit(None).cast("long").alias("term"), F.lit(None).cast("int").alias("type"), F.lit(0).cast("long").alias("size"), F.concat(F.lit("not found (compacted) to "), F.col("gap_end")).alias("note"))
        return rows.unionByName(holes).orderBy("idx")


class StableStore:
    """Pairs by binary key; numbers are eight bytes, most significant first."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        try:
            self.table = Table.open(spark, path)
        except NotFoundError:
            self.table = Table.create(spark, path, "key binary, value binary", "key", 1, not_null=["value"])

    def set(self, key: bytes, value: bytes) -> None:
        self.table.upsert(self.spark.createDataFrame([(bytearray(key), bytearray(value))], "key binary, value binary"))

    def get(self, key: bytes) -> bytes:
        row = self.table.read().where(F.col("key") == F.unhex(F.lit(key.hex()))).first()
        if row is None:
            raise NotFoundError(key)
        return bytes(row.value)

    def set_number(self, key: bytes, value: int) -> None:
        self.set(key, struct.pack(">Q", value))

    def get_number(self, key: bytes) -> int:
        return struct.unpack(">Q", self.get(key))[0]


class PageStore:
    """A database image as a table of pages, to which entries are applied in index order, each once.

    ``propose`` is what a writer calls, ``handle`` what the coordinator does with a request: check its shape, take the
    lease, check its base, apply. Statuses are the log's; an invalid request certainly did not apply.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16, options: Options = Options()):
        self.spark, self.options, self.leading, self.draining = spark, options, True, False
        self.changed, self.compacted = 0, time.time()
        self._lock = threading.Lock()
        try:
            self.table = Table.open(spark, path)
        except NotFoundError:
            self.table = Table.create(spark, path, "pg_no long, data binary", "pg_no", buckets)

    @property
    def applied(self) -> int:
        return self.table.manifest().last_index

    def apply(self, index: int, raw: bytes | None, kind: int = 0) -> int:
        """Applies a log row: other kinds than commands, and entries applied before, only count."""
        m = self.table.manifest()
        if index <= m.last_index or kind != 0 or not raw:
            return m.last_index
        e = wire.decode(raw)
        if (why := wire.problem(e)) is not None:
            raise InvalidChangeError(why)
        rows = [(p["pg_no"], bytearray(p["data"]), KEEP, k) for k, p in enumerate(e["pages"])]
        changes = self.spark.createDataFrame(rows, "pg_no long, data binary, _op string, _seq long")
        beyond = self.table.read(m.version).where(F.col("pg_no") > e["n_truncate"]).select("pg_no", "data", F.lit(DROP).alias("_op"), F.lit(2**40).alias("_seq"))
        own_beyond = changes.where(F.col("pg_no") > e["n_truncate"]).select("pg_no", "data", F.lit(DROP).alias("_op"), F.lit(2**41).alias("_seq"))
        self.table.commit(changes.unionByName(beyond).unionByName(own_beyond), m.version, e["id"], index=index)
        self.changed += len(rows)
        self.tick()
        return index

    def tick(self) -> bool:
        """Compacts if it is time to; to be called now and then where nothing is written."""
        due = self.changed >= self.options.compact_pages or self.changed and time.time() - self.compacted >= self.options.compact_seconds
        if due:
            self.table.compact()
            self.changed, self.compacted = 0, time.time()
        return bool(due)

    def take_lead(self, log_store: LogStore) -> int:
        """Becomes the coordinator: refuses writes until all that the log holds is applied, then accepts them."""
        self.draining, self.leading = True, True
        try:
            return self.catch_up(log_store)
        except Exception:
            self.leading = False
            raise
        finally:
            self.draining = False

    def handle(self, base: int, raw: bytes) -> tuple[str, int]:
        """status and the applied index after a request."""
        try:
            if wire.problem(wire.decode(raw)) is not None:
                return "INVALID", self.applied
        except ValueError:
            return "INVALID", self.applied
        if not self.leading:
            return "NOT_LEADER", self.applied
        if self.draining:
            return "CATCHING_UP", self.applied
        if not self._lock.acquire(timeout=self.options.lease_timeout):
            return "BUSY", self.applied
        try:
            last = self.applied
            if self.table.applied(wire.decode(raw)["id"]):
                return "OK", last
            if base != last:
                return "STALE_BASE", last
            return "OK", self.apply(last + 1, raw)
        except StaleBaseError:
            return "STALE_BASE", self.applied
        except CommitError:
            return "AMBIGUOUS", self.applied
        finally:
            self._lock.release()

    def propose(self, entry_id: str, changed: list[tuple[int, bytes]], n_truncate: int, base: int | None = None) -> int:
        """The new applied index, or the error that the status stands for."""
        raw, until = wire.encode(entry_id, changed, n_truncate), time.time() + self.options.forward_timeout
        status, last = self.handle(self.applied if base is None else base, raw)
        while status in ("BUSY", "CATCHING_UP") and time.time() < until:
            time.sleep(0.05)
            status, last = self.handle(last if base is None else base, raw)
        if status == "OK":
            return last
        code, safe = log.OUTCOMES[status]
        error = {"STALE_BASE": StaleBaseError, "INVALID": InvalidChangeError}.get(status, CommitError)(f"{status} at {last}")
        error.status, error.code, error.safe_to_retry = status, code, safe
        raise error

    def snapshot(self, path: str) -> int:
        """Writes the image as a snapshot stream, a header with the applied index and the pages in order; gives the index.
        A stream that could not be finished is removed."""
        m = self.table.manifest()
        temp = f"{path}.part"
        try:
            with open(temp, "wb") as f:
                f.write(pages.snapshot_header(m.last_index))
                for row in self.table.read(m.version).orderBy("pg_no").toLocalIterator():
                    f.write(row.data)
            os.replace(temp, path)
        finally:
            if os.path.exists(temp):
                os.remove(temp)
        return m.last_index

    def restore(self, path: str) -> int:
        """Replaces the image by a snapshot stream's, in one commit, and gives its applied index."""
        last, image = pages.read_snapshot(self.spark, path)
        m = self.table.manifest()
        now = self.table.read(m.version)
        size, old = (x.select(F.length("data")).first() for x in (image, now))
        if size and old and size[0] != old[0]:
            raise InvalidChangeError(f"pages of {size[0]} bytes do not fit an image of {old[0]}")
        put = image.select("pg_no", "data", F.lit(KEEP).alias("_op"), F.lit(1).alias("_seq"))
        gone = now.join(image.select("pg_no"), "pg_no", "left_anti").select("pg_no", "data", F.lit(DROP).alias("_op"), F.lit(0).alias("_seq"))
        self.table.commit(put.unionByName(gone), m.version, index=last)
        return last

    def catch_up(self, store: LogStore) -> int:
        """Applies what the log holds beyond the applied index, in order; a gap is an error."""
        rows = store.table.read().where(F.col("idx") > self.applied).orderBy("idx").toLocalIterator()
        for row in rows:
            if row.idx != self.applied + 1:
                raise InvalidChangeError(f"missing {self.applied + 1} to {row.idx - 1}")
            self.apply(row.idx, bytes(row.data) if row.data is not None else None, row.type)
        return self.applied
