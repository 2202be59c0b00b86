"""Versioned tables: immutable Parquet files, published one after another by compare-and-swap.

A table is a folder. ``_log/<version>.json`` is a manifest: for every key-hash bucket the folder with its rows, the deltas
on top, and the table's properties; a copy stands beside it. A commit writes its changes, one row for each key, as a delta
and publishes the next manifest; whoever publishes a version first has it, all others are stale. Readers merge the deltas,
last writer wins, and see one manifest, so never part of a commit. After FOLD deltas the buckets that they touch are
written anew, and more buckets are made as the rows grow, so a bucket stays a task's work. Nothing but manifests (a few
kilobytes) and counts go to the driver.

A commit over several tables prepares a manifest in each that names a common decision file. The manifests count once that
file says so; whoever creates it first decides, a writer that meets an undecided one included.
"""

from __future__ import annotations

import hashlib
import json
import os
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field, replace

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from logfold.model import ConstraintError, FatalCommitError, InvalidChangeError, LeaseBusyError, NotFoundError, StaleBaseError

#: Deltas after which the touched buckets are written anew, and rows of a bucket beyond which there will be more buckets.
FOLD = 16
BUCKET_ROWS = 4_000_000
#: Seconds after which an undecided commit over several tables may be given up by others.
UNDECIDED = 30.0
KEEP, DROP = "U", "D"
#: Stores without a rename that fails over an existing file.
OVERWRITING = frozenset({"s3", "s3a", "s3n", "gs", "wasb", "wasbs", "oss", "cos"})


@dataclass(frozen=True)
class Manifest:
    version: int
    schema: str
    key: str
    buckets: int
    folders: dict[str, list[str]] = field(default_factory=dict)
    not_null: list[str] = field(default_factory=list)
    unique: list[list[str]] = field(default_factory=list)
    defaults: dict[str, str] = field(default_factory=dict)
    deltas: list[dict] = field(default_factory=list)  # version, folder and buckets, oldest first
    triggers: list[str] = field(default_factory=list)
    entry: str | None = None  # the commit's own id
    txn: str | None = None  # the decision file of a commit over several tables
    last_index: int = 0
    written_at: float = 0.0


class Files:
    """The few file operations that a table needs, on any store Hadoop knows."""

    def __init__(self, spark: SparkSession, root: str):
        self.root, self.jvm = root, spark._jvm
        self.fs = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())
        self.local = self.fs.getScheme() == "file"

    def _path(self, p: str):
        return self.jvm.org.apache.hadoop.fs.Path(p)

    def exists(self, p: str) -> bool:
        return self.fs.exists(self._path(p))

    def read(self, p: str) -> str:
        source = self.fs.open(self._path(p))
        try:
            return self.jvm.java.lang.String(source.readAllBytes(), "UTF-8")
        finally:
            source.close()

    def write(self, p: str, text: str) -> None:
        out = self.fs.create(self._path(p), True)
        out.write(bytearray(text.encode()))
        out.close()

    def move(self, a: str, b: str) -> bool:
        """For one mover alone."""
        return self.fs.rename(self._path(a), self._path(b))

    def create(self, p: str, text: str) -> bool:
        """Puts a whole file in its place at once; False if there is one. Local files by a hard link, others by a rename
        that the store refuses over an existing file; stores whose rename overwrites are refused."""
        if not self.local and self.fs.getScheme() in OVERWRITING:
            raise InvalidChangeError(f"a rename on {self.fs.getScheme()} may overwrite; such a store can't hold a table's log")
        temp = f"{p}.{uuid.uuid4().hex}"
        self.write(temp, text)
        try:
            if self.local:
                try:
                    os.link(temp.removeprefix("file:").replace("//", "/"), p.removeprefix("file:").replace("//", "/"))
                    return True
                except FileExistsError:
                    return False
            return not self.exists(p) and self.move(temp, p)
        finally:
            self.fs.delete(self._path(temp), False)

    def names(self, p: str) -> list[str]:
        path = self._path(p)
        return [x.getPath().getName() for x in self.fs.listStatus(path)] if self.fs.exists(path) else []

    def delete(self, p: str) -> None:
        self.fs.delete(self._path(p), True)

    def age(self, p: str) -> float:
        path = self._path(p)
        return time.time() - self.fs.getFileStatus(path).getModificationTime() / 1000 if self.fs.exists(path) else 0.0


class Table:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.files = Files(spark, self.path)
        self.last_rejection: Exception | None = None

    # Opening.

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: str, key: str, buckets: int = 16, not_null: list[str] = (), unique: list[list[str]] = (), defaults: dict[str, str] | None = None) -> Table:
        made = cls(spark, path)
        names = StructType.fromDDL(schema).fieldNames()
        if key not in names:
            raise InvalidChangeError(f"no column {key}")
        if made.files.names(f"{made.path}/data") and not made.files.names(f"{made.path}/_log"):
            raise InvalidChangeError(f"{path} holds data without a log; it is not a new table")
        first = Manifest(0, schema, key, buckets, not_null=sorted({key, *not_null}), unique=[list(u) for u in unique], defaults=defaults or {}, written_at=time.time())
        if not made._put(first):
            raise StaleBaseError(f"{path} is a table already")
        return made

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Table:
        """An existing table; what a commit that never came to its end left behind is settled by the next writer."""
        found = cls(spark, path)
        if not found.versions():
            raise NotFoundError(path)
        return found

    def _manifest(self, version: int) -> str:
        return f"{self.path}/_log/{version:020d}.json"

    def _put(self, m: Manifest) -> bool:
        """Publishes a manifest and its copy."""
        text = json.dumps(asdict(m))
        if not self.files.create(self._manifest(m.version), text):
            return False
        try:
            self.files.write(self._manifest(m.version).replace(".json", ".copy"), text)
        except (OSError, Py4JError):
            pass  # the copy is a spare
        return True

    def _load(self, version: int) -> Manifest:
        """A manifest, or its copy where the first can't be read."""
        path = self._manifest(version)
        try:
            return Manifest(**json.loads(self.files.read(path)))
        except (ValueError, TypeError):
            return Manifest(**json.loads(self.files.read(path.replace(".json", ".copy"))))

    def _published(self) -> list[int]:
        return sorted(int(x[:-5]) for x in self.files.names(f"{self.path}/_log") if x.endswith(".json"))

    def _decided(self, m: Manifest) -> str | None:
        """commit, abort, or None for a commit over several tables that is under way."""
        if m.txn is None:
            return "commit"
        return self.files.read(m.txn) if self.files.exists(m.txn) else None

    def versions(self) -> list[int]:
        return [v for v in self._published() if self._decided(self._load(v)) == "commit"]

    @property
    def version(self) -> int:
        return next((v for v in reversed(self._published()) if self._decided(self._load(v)) == "commit"), -1)

    def manifest(self, version: int | None = None) -> Manifest:
        at = self.version if version is None else version
        if at not in self._published():
            raise NotFoundError(version)
        m = self._load(at)
        if self._decided(m) != "commit":
            raise NotFoundError(version)
        return m

    # Reading.

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of one version, for as long as its files are there; pin() keeps them."""
        return self._rows(self.manifest(version))

    @contextmanager
    def pin(self, version: int | None = None, seconds: float = 3600.0) -> Iterator[DataFrame]:
        """The rows of one version, which no vacuum takes away meanwhile. A reader that died loses its mark in the end."""
        m = self.manifest(version)
        mark = f"{self.path}/_readers/{uuid.uuid4().hex}.json"
        self.files.write(mark, json.dumps({"version": m.version, "until": time.time() + seconds}))
        try:
            yield self._rows(m)
        finally:
            self.files.delete(mark)

    def pinned(self) -> set[int]:
        """Versions that readers hold."""
        found = set()
        for name in self.files.names(f"{self.path}/_readers"):
            if name.endswith(".json"):
                mark = json.loads(self.files.read(f"{self.path}/_readers/{name}"))
                if mark["until"] >= time.time():
                    found.add(mark["version"])
                else:
                    self.files.delete(f"{self.path}/_readers/{name}")
        return found

    def _rows(self, m: Manifest, buckets: set[int] | None = None) -> DataFrame:
        kinds = StructType.fromDDL(m.schema)
        names = kinds.fieldNames()
        wanted = lambda b: buckets is None or int(b) in buckets
        folders = [f"{self.path}/{p}" for b, ps in m.folders.items() if wanted(b) for p in ps]
        base = (self.spark.read.schema(m.schema).parquet(*folders) if folders else self.spark.createDataFrame([], m.schema)).select(*[F.col(f"`{n}`") for n in names])
        parts = []
        for d in m.deltas:
            at = [f"{self.path}/{d['folder']}/_bucket={b}" for b in d["buckets"] if wanted(b)]
            if at:
                parts.append(self.spark.read.schema(f"{m.schema}, _op string").parquet(*at).withColumn("_v", F.lit(d["version"])))
        if not parts:
            return base
        changes = parts[0]
        for x in parts[1:]:
            changes = changes.unionByName(x)
        if len(parts) > 1:  # a delta has each key once
            changes = changes.groupBy(F.col(f"`{m.key}`").alias("_k")).agg(F.max_by(F.struct("_op", *[F.col(f"`{n}`") for n in names]), "_v").alias("_r")).select("_r.*")
        left = base.join(changes.select(m.key), m.key, "left_anti").select(*[F.col(f"`{n}`") for n in names])
        return left.unionByName(changes.where(F.col("_op") == KEEP).select(*[F.col(f"`{n}`") for n in names]))

    def get(self, key, version: int | None = None) -> dict | None:
        """One row by its key, from its bucket alone."""
        m = self.manifest(version)
        kind = StructType.fromDDL(m.schema)[m.key].dataType
        bucket = self.spark.range(1).select(self._bucket(F.lit(key).cast(kind), m.buckets)).first()[0]
        row = self._rows(m, {bucket}).where(F.col(m.key) == F.lit(key)).first()
        return row.asDict() if row else None

    @staticmethod
    def _bucket(key: Column, buckets: int) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")

    def history(self) -> DataFrame:
        rows = [(m.version, m.written_at, m.last_index, len(m.folders)) for m in map(self.manifest, self.versions())]
        return self.spark.createDataFrame(rows, "version long, written_at double, last_index long, buckets long")

    # Writing.

    @contextmanager
    def lease(self, timeout: float = 1.0, stale: float = 60.0) -> Iterator[None]:
        """The single writer's lease; a holder that died loses it after a while, to one taker: the move of its file
        succeeds once. Safety comes from the manifest's compare-and-swap, the lease only keeps writers from working in vain."""
        path, until, own = f"{self.path}/_lease", time.time() + timeout, uuid.uuid4().hex
        while not self.files.create(path, own):
            if self.files.age(path) > stale:
                try:
                    held = self.files.read(path)
                    if self.files.move(path, f"{path}.{own}") and self.files.read(f"{path}.{own}") != held:
                        self.files.move(f"{path}.{own}", path)  # it was taken over and is fresh
                    self.files.delete(f"{path}.{own}")
                except (OSError, Py4JError):
                    pass
            elif time.time() > until:
                self.last_rejection = LeaseBusyError("another writer holds the lease")
                raise self.last_rejection
            else:
                time.sleep(0.02)
        try:
            yield
        finally:
            if self.files.exists(path) and self.files.read(path) == own:
                self.files.delete(path)

    def _marker(self, entry_id: str) -> str:
        return f"{self.path}/_entries/{hashlib.sha256(entry_id.encode()).hexdigest()}"

    def applied(self, entry_id: str) -> bool:
        """Whether an entry's commit is part of the table, however long ago."""
        marker = self._marker(entry_id)
        if not self.files.exists(marker):
            return False
        said = self.files.read(marker)
        if said == "done":
            return True
        if int(said) not in self._published():
            return False
        m = self._load(int(said))
        return m.entry == entry_id and self._decided(m) == "commit"

    def commit(self, changes: DataFrame, base_version: int | None = None, entry_id: str | None = None, strict_noop: bool = True, index: int | None = None, txn: str | None = None) -> int:
        """Applies changes (the table's columns, ``_op`` U or D, ``_seq`` their order) and returns the new version.

        Fails with StaleBaseError unless the base is the newest version; a change set without rows is checked too, unless
        strict_noop is False. A repeated entry_id returns its table's version and changes nothing. With txn, the path of a
        decision file, the commit only counts once decide() says so.
        """
        try:
            done = self._commit(changes, base_version, entry_id, strict_noop, index, txn)
            self.last_rejection = None
            return done
        except Exception as e:
            self.last_rejection = e
            raise

    def decide(self, txn: str, what: str = "commit") -> str:
        """Settles a commit over several tables, unless that was done; gives what was decided first."""
        return what if self.files.create(txn, what) else self.files.read(txn)

    def _settle(self) -> int:
        """The last version published, once nothing newer than the newest visible one is undecided."""
        published = self._published()
        for v in reversed(published):
            m = self._load(v)
            if self._decided(m) is not None:
                break
            if time.time() - m.written_at < UNDECIDED:
                raise StaleBaseError(f"version {v} is being committed by another writer")
            self.decide(m.txn, "abort")
        return published[-1]

    def _commit(self, changes: DataFrame, base_version: int | None, entry_id: str | None, strict_noop: bool, index: int | None, txn: str | None) -> int:
        if entry_id is not None and self.applied(entry_id):
            return self.version
        last = self._settle()
        m = self.manifest()
        missing = {"_op", "_seq", m.key} - set(changes.columns)
        if missing:
            raise InvalidChangeError(f"change set without {', '.join(sorted(missing))}")
        kinds = StructType.fromDDL(m.schema)
        names = kinds.fieldNames()
        for n in names:
            if n not in changes.columns:
                changes = changes.withColumn(n, F.expr(m.defaults.get(n, "NULL")))
        held = changes.select(*[F.col(f"`{n}`").cast(kinds[n].dataType).alias(n) for n in names], "_op", "_seq").persist()
        try:
            keep = F.col("_op") == KEEP
            known = F.coalesce(F.col("_op").isin(KEEP, DROP), F.lit(False))
            checks = {c: F.count_if(keep & F.col(f"`{c}`").isNull()) for c in m.not_null}
            said = held.agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col(f"`{m.key}`").isNull() | ~known).alias("_bad"), *[v.alias(f"_null_{c}") for c, v in checks.items()]).first()
            bad = [c for c in m.not_null if said[f"_null_{c}"]]
            if bad or said["_bad"]:
                raise ConstraintError(f"null in {', '.join(bad) or m.key}, or an unknown change")
            if base_version is not None and base_version != m.version and (said["_n"] or strict_noop):
                raise StaleBaseError(f"base {base_version}, but the table is at {m.version}")
            if not said["_n"]:
                return m.version
            newest = held.groupBy(F.col(f"`{m.key}`").alias("_k")).agg(F.max_by(F.struct("_op", *[F.col(f"`{n}`") for n in names]), "_seq").alias("_r")).select("_r.*")
            return self._publish(m, last + 1, newest, entry_id, index, txn)
        finally:
            held.unpersist()

    def _written(self, rows: DataFrame, key: str, buckets: int, folder: str, tasks: int | None = None) -> list[int]:
        """Writes rows by bucket and gives the buckets that have any."""
        dealt = rows.withColumn("_bucket", self._bucket(F.col(f"`{key}`"), buckets))
        (dealt.repartition(tasks, "_bucket") if tasks else dealt.repartition("_bucket")).write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        return sorted(int(x[8:]) for x in self.files.names(f"{self.path}/{folder}") if x.startswith("_bucket="))

    def _publish(self, m: Manifest, at: int, newest: DataFrame, entry_id: str | None, index: int | None, txn: str | None) -> int:
        """Publishes a delta; newest has each changed key once, with _op."""
        folder = f"data/{at}-{uuid.uuid4().hex[:12]}"
        marker = self._marker(entry_id) if entry_id else None
        try:
            written = self._written(newest, m.key, m.buckets, folder)
            delta = {"version": at, "folder": folder, "buckets": written}
            new = replace(m, version=at, deltas=[*m.deltas, delta], written_at=time.time(), entry=entry_id, last_index=index if index is not None else m.last_index, txn=txn)
            self._check_unique(new, delta)
            if marker:
                self.files.write(marker, str(at))
            if not self._put(new):
                raise StaleBaseError(f"version {at} was published by another writer")
        except (ConstraintError, StaleBaseError):
            self.files.delete(f"{self.path}/{folder}")
            if marker and self.files.exists(marker) and self.files.read(marker) == str(at):
                self.files.delete(marker)
            raise
        except (OSError, Py4JError) as e:
            raise FatalCommitError(str(e)) from e
        if txn is None and len(new.deltas) >= FOLD:
            try:
                self.compact(all_buckets=False)
            except StaleBaseError:
                pass  # another writer was faster and may fold
        return at

    def _check_unique(self, new: Manifest, delta: dict) -> None:
        """That no row put by the delta shares a unique value; only such values are looked up."""
        if not new.unique:
            return
        put = self.spark.read.schema(f"{new.schema}, _op string").parquet(f"{self.path}/{delta['folder']}").where(F.col("_op") == KEEP)
        for columns in new.unique:
            rows = self._rows(new).dropna(subset=columns)
            twice = rows.join(put.select(*columns).dropna().distinct(), list(columns), "left_semi").groupBy(*columns).count().where("count > 1")
            if not twice.isEmpty():
                raise ConstraintError(f"{', '.join(columns)} must be unique")

    # Changes as a caller writes them.

    def _puts(self, rows: DataFrame, op: str = KEEP) -> DataFrame:
        return rows.withColumn("_op", F.lit(op)).withColumn("_seq", F.monotonically_increasing_id())

    def check_new(self, rows: DataFrame, old: DataFrame, key: str) -> None:
        """That a key is not there already, nor twice among the rows."""
        twice = rows.groupBy(F.col(f"`{key}`")).count().where("count > 1")
        if not twice.isEmpty() or not rows.join(old.select(key), key, "left_semi").isEmpty():
            raise ConstraintError(f"{key} must be unique")

    def insert(self, rows: DataFrame, base_version: int | None = None, entry_id: str | None = None) -> int:
        """Fails if a key is there already, or twice among the rows."""
        if entry_id is not None and self.applied(entry_id):
            return self.version
        m = self.manifest(base_version)
        self.check_new(rows, self._rows(m), m.key)
        return self.commit(self._puts(rows), m.version, entry_id)

    def upsert(self, rows: DataFrame, base_version: int | None = None, entry_id: str | None = None) -> int:
        return self.commit(self._puts(rows), base_version, entry_id)

    def update(self, where: Column | str, base_version: int | None = None, **values: Column | str) -> int:
        m = self.manifest(base_version)
        where = F.expr(where) if isinstance(where, str) else where
        changed = self._rows(m).where(where).withColumns({k: F.expr(v) if isinstance(v, str) else v for k, v in values.items()})
        if m.key in values:
            raise InvalidChangeError("a key cannot be updated; delete and insert")
        return self.commit(self._puts(changed), m.version)

    def delete(self, where: Column | str, base_version: int | None = None) -> int:
        m = self.manifest(base_version)
        return self.commit(self._puts(self._rows(m).where(F.expr(where) if isinstance(where, str) else where), DROP), m.version)

    # Upkeep.

    def _replaced(self, m: Manifest, at: int, **changed) -> int:
        new = replace(m, version=at, written_at=time.time(), entry=None, txn=None, **changed)
        if not self._put(new):
            raise StaleBaseError(f"version {at} was published by another writer")
        return at

    def compact(self, all_buckets: bool = True) -> int:
        """Folds the deltas into their buckets, or writes all buckets anew; more of them if the rows have grown."""
        at = self._settle() + 1
        m = self.manifest()
        rows = self._rows(m).count()
        buckets = m.buckets
        while rows > buckets * BUCKET_ROWS:
            buckets *= 2
        touched = set(range(buckets)) if all_buckets or buckets != m.buckets else {b for d in m.deltas for b in d["buckets"]}
        folder = f"data/{at}-{uuid.uuid4().hex[:12]}"
        written = self._written(self._rows(m, None if buckets != m.buckets else touched), m.key, buckets, folder, len(touched) or 1)
        kept = {b: p for b, p in m.folders.items() if buckets == m.buckets and int(b) not in touched}
        return self._replaced(m, at, buckets=buckets, deltas=[], folders=kept | {str(b): [f"{folder}/_bucket={b}"] for b in written})

    def set_triggers(self, triggers: list[str]) -> int:
        at = self._settle() + 1
        return self._replaced(self.manifest(), at, triggers=triggers)

    def restore(self, version: int) -> int:
        """Publishes an old version's rows as the newest."""
        at = self._settle() + 1
        return self._replaced(self.manifest(version), at)

    def vacuum(self, keep: int = 2, min_age: float = 3600.0) -> list[str]:
        """Forgets all but the newest versions and those that readers hold, then deletes data that none of them names.
        Files younger than min_age may belong to a commit under way and stay."""
        visible, pinned = self.versions(), self.pinned()
        kept = {v for v in visible if v in visible[-keep:] or v in pinned}
        held = [self.manifest(v) for v in kept] + [m for m in map(self._load, self._published()) if self._decided(m) is None]
        used = {p.split("/")[1] for m in held for p in [*(x for ps in m.folders.values() for x in ps), *(d["folder"] for d in m.deltas)]}
        for v in visible:
            if v not in kept:
                entry = self._load(v).entry
                if entry:
                    self.files.write(self._marker(entry), "done")
                self.files.delete(self._manifest(v))
                self.files.delete(self._manifest(v).replace(".json", ".copy"))
        gone = [n for n in self.files.names(f"{self.path}/data") if n not in used and self.files.age(f"{self.path}/data/{n}") >= min_age]
        for n in gone:
            self.files.delete(f"{self.path}/data/{n}")
        return gone

    def snapshot(self, path: str) -> int:
        """Copies the newest version to a new table and returns its version."""
        m = self.manifest()
        copy = Table.create(self.spark, path, m.schema, m.key, m.buckets, m.not_null, m.unique, m.defaults)
        folder = f"data/1-{uuid.uuid4().hex[:12]}"
        written = copy._written(self._rows(m), m.key, m.buckets, folder, m.buckets)
        return copy._replaced(copy.manifest(), 1, folders={str(b): [f"{folder}/_bucket={b}"] for b in written}, last_index=m.last_index, triggers=m.triggers)

    def diff(self, a: int, b: int) -> DataFrame:
        """Keys whose rows differ between two versions, with only_a, only_b or differ. Buckets that both share are skipped."""
        x, y = self.manifest(a), self.manifest(b)

        def state(m: Manifest, k: int) -> tuple:
            return (m.folders.get(str(k)), [d["folder"] for d in m.deltas if k in d["buckets"]])

        moved = {k for k in range(x.buckets) if state(x, k) != state(y, k)} if x.buckets == y.buckets else None
        names = [n for n in StructType.fromDDL(x.schema).fieldNames() if n != x.key]
        left = self._rows(x, moved).select(F.col(x.key), F.struct(*names).alias("_a"), F.lit(True).alias("_in_a"))
        right = self._rows(y, moved).select(F.col(x.key), F.struct(*names).alias("_b"), F.lit(True).alias("_in_b"))
        status = F.when(F.col("_in_b").isNull(), "only_a").when(F.col("_in_a").isNull(), "only_b").when(~F.col("_a").eqNullSafe(F.col("_b")), "differ")
        return left.join(right, x.key, "full_outer").select(x.key, status.alias("status")).where("status IS NOT NULL")

    def integrity_check(self) -> list[str]:
        """What is wrong with the newest version; empty if nothing is."""
        m, found = self.manifest(), []
        for b, p in [*((b, p) for b, ps in m.folders.items() for p in ps), *((b, f"{d['folder']}/_bucket={b}") for d in m.deltas for b in d["buckets"])]:
            if not self.files.names(f"{self.path}/{p}"):
                found.append(f"bucket {b} has no files in {p}")
        if found:
            return found
        rows = self._rows(m)
        for columns in [[m.key], *m.unique]:
            if rows.dropna(subset=columns).groupBy(*columns).count().where("count > 1").limit(1).count():
                found.append(f"{', '.join(columns)} is not unique")
        return found + [f"null in {c}" for c in m.not_null if rows.where(F.col(c).isNull()).limit(1).count()]
