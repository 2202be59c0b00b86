"""Versioned tables: commits, races, constraints, upkeep, and a random workload against sqlite3."""

import random
import sqlite3
import threading

import pytest
from pyspark.sql import functions as F

from logfold.model import ConstraintError, InvalidChangeError, LeaseBusyError, NotFoundError, StaleBaseError
from logfold.streaming import apply
from logfold.table import Table


@pytest.fixture
def make(spark, tmp_path):
    return lambda name="t", schema="id long, v string", **more: Table.create(spark, f"{tmp_path}/{name}", schema, "id", buckets=4, **more)


def dump(t, version=None):
    return sorted(map(tuple, t.read(version).collect()))


def test_versions(spark, make):
    t = make()
    rows = spark.createDataFrame([(k, f"row{k}") for k in range(20)], "id long, v string")
    assert t.insert(rows) == 1 and t.version == 1
    t.update("id < 3", v=F.concat("v", F.lit("x")))
    t.delete("id >= 18")
    assert dump(t)[:4] == [(0, "row0x"), (1, "row1x"), (2, "row2x"), (3, "row3")] and len(dump(t)) == 18
    assert dump(t, 1) == sorted(map(tuple, rows.collect())) and dump(t, 0) == []
    assert t.get(5) == {"id": 5, "v": "row5"} and t.get(19) is None
    assert sorted(map(tuple, t.diff(1, 3).collect())) == [(0, "differ"), (1, "differ"), (2, "differ"), (18, "only_a"), (19, "only_a")]
    t.restore(1)
    assert dump(t) == dump(t, 1) and t.integrity_check() == []
    before = dump(t)
    t.compact()
    assert dump(t) == before and t.history().count() == 6
    assert t.vacuum(keep=1, min_age=0) and dump(t) == before and t.versions() == [5]
    with pytest.raises(NotFoundError, match="not found"):
        t.read(1)
    with pytest.raises(NotFoundError):
        Table.open(spark, t.path + "-none")


def test_stale_base_replay_and_noop(spark, make):
    t = make()
    one = spark.createDataFrame([(1, "a")], "id long, v string")
    t.upsert(one, base_version=0, entry_id="e1")
    assert t.upsert(one.withColumn("v", F.lit("b")), entry_id="e1") == 1 and dump(t) == [(1, "a")]
    with pytest.raises(StaleBaseError) as e:
        t.upsert(one, base_version=0)
    assert e.value.safe_to_retry and t.last_rejection is e.value
    with pytest.raises(StaleBaseError):
        t.commit(t._puts(one.limit(0)), base_version=0)
    assert t.commit(t._puts(one.limit(0)), base_version=0, strict_noop=False) == 1 and t.last_rejection is None


def test_constraints(spark, make):
    t = make("c", "id long, key string, rev long, n long", not_null=["key"], unique=[["key", "rev"]], defaults={"n": "0"})
    t.insert(spark.createDataFrame([(1, "a", 1), (2, "a", 2)], "id long, key string, rev long"))
    assert dump(t) == [(1, "a", 1, 0), (2, "a", 2, 0)]
    for rows in ([(3, None, 1)], [(3, "a", 2)], [(None, "b", 1)]):
        with pytest.raises(ConstraintError):
            t.upsert(spark.createDataFrame(rows, "id long, key string, rev long"))
    with pytest.raises(ConstraintError):
        t.insert(spark.createDataFrame([(1, "z", 9)], "id long, key string, rev long"))
    with pytest.raises(InvalidChangeError):
        t.commit(spark.createDataFrame([(1,)], "id long"))
    with pytest.raises(InvalidChangeError):
        t.update("id = 1", id="id + 5")
    assert t.version == 1


def test_last_writer_wins_within_a_commit(spark, make):
    t = make()
    t.commit(spark.createDataFrame([(1, "a", "U", 1), (1, "c", "U", 3), (1, "b", "U", 2), (2, "x", "U", 1), (2, None, "D", 2)], "id long, v string, _op string, _seq long"))
    assert dump(t) == [(1, "c")]


def test_concurrent_increments_lose_nothing(spark, make):
    t = make("n", "id long, v long")
    t.insert(spark.createDataFrame([(1, 0)], "id long, v long"))

    def work():
        own = Table.open(spark, t.path)
        for _ in range(3):
            while True:
                base = own.version
                try:
                    own.update("id = 1", base, v="v + 1")
                    break
                except StaleBaseError:
                    pass

    threads = [threading.Thread(target=work) for _ in range(4)]
    [x.start() for x in threads]
    [x.join() for x in threads]
    assert dump(t) == [(1, 12)] and t.version == 13


def test_lease(make):
    t = make()
    with t.lease():
        with pytest.raises(LeaseBusyError):
            with t.lease(timeout=0.1):
                pass
    with t.lease():
        pass


def test_crash_before_publication_leaves_the_table(spark, make, monkeypatch):
    t = make()
    t.upsert(spark.createDataFrame([(1, "a")], "id long, v string"))
    monkeypatch.setattr(t.files, "create", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        t.upsert(spark.createDataFrame([(1, "b")], "id long, v string"))
    again = Table.open(spark, t.path)
    assert dump(again) == [(1, "a")] and again.integrity_check() == []
    assert len(again.vacuum(min_age=0)) == 1


def test_snapshot(spark, make, tmp_path):
    t = make()
    t.upsert(spark.createDataFrame([(k, "a") for k in range(9)], "id long, v string"))
    t.snapshot(f"{tmp_path}/copy")
    assert dump(Table.open(spark, f"{tmp_path}/copy")) == dump(t)


def test_random_workload_equals_sqlite(spark, make):
    r = random.Random(11)
    t = make("w", "id long, key string, rev long, gone long")
    db = sqlite3.connect(":memory:")
    db.execute("CREATE TABLE w(id INTEGER PRIMARY KEY, key TEXT, rev INTEGER, gone INTEGER)")
    for clock in range(1, 16):
        kind = r.choice(["put", "put", "soft", "drain"])
        if kind == "put":
            rows = [(r.randrange(25), f"k{r.randrange(5)}", clock, None) for _ in range(r.randint(1, 6))]
            rows = list({x[0]: x for x in rows}.values())
            db.executemany("INSERT OR REPLACE INTO w VALUES (?, ?, ?, ?)", rows)
            t.upsert(spark.createDataFrame(rows, "id long, key string, rev long, gone long"))
        elif kind == "soft":
            k = f"k{r.randrange(5)}"
            db.execute("UPDATE w SET gone = ? WHERE key = ? AND gone IS NULL", (clock, k))
            t.update(f"key = '{k}' AND gone IS NULL", gone=f"{clock}L")
        else:
            db.execute("DELETE FROM w WHERE gone <= ?", (clock - 2,))
            t.delete(f"gone <= {clock - 2}")
    assert sorted(t.read().collect(), key=str) == sorted(map(tuple, db.execute("SELECT * FROM w")), key=str)


def test_stream_equals_batch(spark, make, tmp_path):
    r = random.Random(2)
    log = [(k, r.randrange(30), f"v{k}", r.choice("UUUD")) for k in range(1, 121)]
    schema = "idx long, id long, v string, op string"
    for n in range(4):
        part = log[n * 30 : n * 30 + 30] + (log[n * 30 - 10 : n * 30] if n else [])
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
    t = make()
    for _ in range(2):  # the second run finds nothing new
        apply.run(t, apply.log_stream(spark, f"{tmp_path}/log", schema, 2), f"{tmp_path}/ck").awaitTermination()
    want = {}
    for _, k, v, op in log:
        want.pop(k, None)
        if op == "U":
            want[k] = v
    assert dict(dump(t)) == want and t.manifest().last_index == 120
    version = t.version
    apply.apply_batch(t, spark.createDataFrame(log, schema), 99)
    assert t.version == version
    with pytest.raises(apply.GapError):
        apply.apply_batch(t, spark.createDataFrame([(125, 1, "x", "U")], schema), 100)
    apply.apply_batch(t, spark.createDataFrame([(125, 1, "x", "U")], schema), 100, refuse_gaps=False)
    assert apply.late(t) is None and t.get(1)["v"] == "x"
    apply.apply_batch(t, spark.createDataFrame([(123, 77, "late", "U")], schema), 101, refuse_gaps=False)
    assert t.get(77) is None and [(r.idx, r.v, r.status) for r in apply.late(t).collect()] == [(123, "late", "STALE_BASE")]


def test_replays_are_known_for_ever(spark, make, monkeypatch):
    t = make()
    monkeypatch.setattr("logfold.table.FOLD", 4)
    one = lambda k: spark.createDataFrame([(k, f"v{k}")], "id long, v string")
    for k in range(6):
        t.upsert(one(k), entry_id=f"e{k}")
    t.vacuum(keep=1, min_age=0)
    version = t.version
    for k in range(6):
        assert t.upsert(one(99), entry_id=f"e{k}") == version
    assert len(dump(t)) == 6 and t.get(99) is None


def test_deltas_fold_and_buckets_grow(spark, make, monkeypatch):
    t = make()
    monkeypatch.setattr("logfold.table.FOLD", 5)
    monkeypatch.setattr("logfold.table.BUCKET_ROWS", 10)
    want = {}
    for k in range(7):
        rows = [(j, f"{k}") for j in range(k * 7, k * 7 + 12)]
        want |= dict(rows)
        t.upsert(spark.createDataFrame(rows, "id long, v string"))
        if k % 2:
            t.delete(f"id = {k}")
            want.pop(k)
        assert dict(dump(t)) == want
    m = t.manifest()
    assert m.buckets > 4 and len(m.deltas) < 5 and t.integrity_check() == []
    t.compact()
    assert dict(dump(t)) == want and t.manifest().deltas == [] and t.get(20)["v"] == want[20]


def test_readers_hold_back_vacuum_and_spare_manifests(spark, make):
    t = make()
    t.upsert(spark.createDataFrame([(1, "a")], "id long, v string"))
    with t.pin() as rows:
        for k in range(3):
            t.upsert(spark.createDataFrame([(1, f"{k}")], "id long, v string"))
            t.compact()
        t.vacuum(keep=1, min_age=0)
        assert rows.collect() == [(1, "a")] and 1 in t.versions()
    t.vacuum(keep=1, min_age=0)
    assert t.versions() == [t.version]
    path = t._manifest(t.version).removeprefix("file://")
    with open(path, "w") as f:
        f.write('{"version"')  # torn
    assert dump(t) == [(1, "2")]


def test_data_without_a_log_is_refused(spark, make, tmp_path):
    t = make()
    t.upsert(spark.createDataFrame([(1, "a")], "id long, v string"))
    t.files.delete(f"{t.path}/_log")
    with pytest.raises(InvalidChangeError, match="without a log"):
        make()


def test_an_undecided_commit_is_given_up(spark, make, monkeypatch):
    t = make()
    one = spark.createDataFrame([(1, "a")], "id long, v string")
    txn = f"{t.path}/_txn"
    assert t.commit(t._puts(one), txn=txn) == 1 and t.version == 0 and dump(t) == []
    with pytest.raises(StaleBaseError):
        t.upsert(one)  # another writer is at it
    monkeypatch.setattr("logfold.table.UNDECIDED", 0.0)
    assert t.upsert(one.withColumn("v", F.lit("b"))) == 2 and t.decide(txn) == "abort" and dump(t) == [(1, "b")]
