"""Log, stable and page stores."""

import threading

import pytest

from logfold.model import CommitError, InvalidChangeError, NotFoundError, StaleBaseError
from logfold.sources import entry
from logfold.store import LogStore, Options, PageStore, StableStore


def test_log(spark, tmp_path):
    s = LogStore(spark, f"{tmp_path}/log", 2)
    assert s.bounds() == (0, 0)
    s.store([{"idx": k, "term": 1, "data": b"x" * k} for k in (3, 4, 7)])
    s.store([{"idx": 4, "term": 2, "data": b"new"}])
    assert s.bounds() == (3, 7) and bytes(s.get(4)["data"]) == b"new"
    with pytest.raises(NotFoundError, match="^not found$"):
        s.get(5)
    assert [(r.idx, r.size, r.note) for r in s.scan().collect()] == [(3, 3, None), (4, 3, None), (5, 0, "not found (compacted) to 6"), (7, 7, None)]
    s.delete_range(3, 4)
    assert LogStore(spark, f"{tmp_path}/log").bounds() == (7, 7)


def test_stable(spark, tmp_path):
    s = StableStore(spark, f"{tmp_path}/kv")
    with pytest.raises(NotFoundError, match="^not found$"):
        s.get(b"a")
    s.set(b"a", b"1")
    s.set(b"a", b"2")
    s.set_number(b"n", 2**40 + 7)
    assert s.get(b"a") == b"2" and s.get_number(b"n") == 2**40 + 7 and s.get(b"n") == (2**40 + 7).to_bytes(8, "big")


def image(s):
    return {r.pg_no: bytes(r.data) for r in s.table.read().collect()}


def test_pages(spark, tmp_path):
    s = PageStore(spark, f"{tmp_path}/db", 2, Options(forward_timeout=0.2, compact_pages=4))
    assert s.propose("a", [(1, b"one"), (2, b"two"), (3, b"three")], 3) == 1
    assert s.propose("b", [(1, b"uno"), (1, b"UNO")], 2) == 2
    assert image(s) == {1: b"UNO", 2: b"two"}
    assert s.propose("b", [(9, b"again")], 9) == 2  # applied once
    with pytest.raises(StaleBaseError) as e:
        s.propose("c", [(1, b"x")], 2, base=1)
    assert e.value.safe_to_retry and e.value.code == "BUSY"
    for bad in (([], 1), ([(1, b"x")], 0), ([(0, b"x")], 1), ([(1, b"")], 1)):
        with pytest.raises(InvalidChangeError) as e:
            s.propose("d", *bad)
        assert not e.value.safe_to_retry
    assert s.handle(2, b"\xff")[0] == "INVALID"
    for state, status in (("leading", "NOT_LEADER"), ("draining", "CATCHING_UP")):
        setattr(s, state, state == "draining")
        with pytest.raises(CommitError) as e:
            s.propose("e", [(1, b"x")], 2)
        assert e.value.status == status and e.value.safe_to_retry
        setattr(s, state, state != "draining")
    assert image(s) == {1: b"UNO", 2: b"two"} and s.applied == 2


def test_catch_up_and_race(spark, tmp_path):
    log = LogStore(spark, f"{tmp_path}/log", 2)
    log.store([{"idx": 1, "data": entry.encode("a", [(1, b"1")], 1)}, {"idx": 2, "type": 2}, {"idx": 3, "data": entry.encode("b", [(2, b"2")], 2)}])
    s = PageStore(spark, f"{tmp_path}/db", 2)
    s.apply(1, entry.encode("a", [(1, b"1")], 1))
    with pytest.raises(InvalidChangeError, match="missing 2"):
        s.catch_up(log)
    log.store([{"idx": 2, "data": entry.encode("c", [(1, b"one")], 1)}])
    assert s.catch_up(log) == 3 and image(s) == {1: b"one", 2: b"2"}
    said = []
    threads = [threading.Thread(target=lambda k=k: said.append(s.handle(3, entry.encode(f"w{k}", [(1, b"%d" % k)], 2))[0])) for k in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(said)[0] == "OK" or "OK" in said
    assert said.count("OK") == 1 and set(said) <= {"OK", "STALE_BASE", "BUSY"}


def test_taking_the_lead_drains_the_log(spark, tmp_path):
    log = LogStore(spark, f"{tmp_path}/log", 2)
    log.store([{"idx": 1, "data": entry.encode("a", [(1, b"1")], 1)}])
    s = PageStore(spark, f"{tmp_path}/db", 2, Options(forward_timeout=0.2, compact_seconds=0.0))
    s.leading = False
    assert s.handle(0, entry.encode("x", [(1, b"x")], 1))[0] == "NOT_LEADER"
    assert s.take_lead(log) == 1 and s.leading and not s.draining and image(s) == {1: b"1"}
    assert s.table.manifest().deltas == [] and not s.tick()  # compacted as time was up
    assert s.propose("b", [(2, b"2")], 2) == 2
    log.store([{"idx": 9, "data": entry.encode("c", [(1, b"9")], 1)}])
    with pytest.raises(InvalidChangeError, match="missing 3"):
        s.take_lead(log)
    assert not s.leading


def test_snapshot_and_restore(spark, tmp_path):
    first = bytearray(512)
    first[16:18] = (512).to_bytes(2, "big")
    a, b = PageStore(spark, f"{tmp_path}/a", 2), PageStore(spark, f"{tmp_path}/b", 2)
    a.propose("1", [(1, bytes(first)), (2, b"x" * 512)], 2)
    b.propose("1", [(k, b"y" * 512) for k in range(1, 5)], 4)
    assert a.snapshot(f"{tmp_path}/snap") == 1 and b.restore(f"{tmp_path}/snap") == 1
    assert image(a) == image(b) and b.applied == 1
    c = PageStore(spark, f"{tmp_path}/c", 2)
    c.propose("1", [(1, b"z" * 1024)], 1)
    with pytest.raises(InvalidChangeError):
        c.restore(f"{tmp_path}/snap")
