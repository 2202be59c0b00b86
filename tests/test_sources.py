"""File formats, on logs and databases that the standard library's sqlite3 writes."""

import shutil
import sqlite3
import struct

import pytest

from logfold.functions.checksum import checksum
from logfold.model import NotFoundError
from logfold.sources import entry, pages, wal


@pytest.fixture
def database(tmp_path):
    """A database with a log of several transactions, copied while open."""
    path = str(tmp_path / "a.db")
    db = sqlite3.connect(path, isolation_level=None)
    db.execute("PRAGMA page_size=1024")
    db.execute("PRAGMA journal_mode=WAL")
    db.execute("PRAGMA wal_autocheckpoint=0")
    db.execute("CREATE TABLE t(id INTEGER PRIMARY KEY, v TEXT)")
    for k in range(5):
        db.execute("INSERT INTO t(v) SELECT hex(randomblob(40)) FROM (WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 60) SELECT n FROM r)")
    db.execute("UPDATE t SET v = v || 'x' WHERE id % 3 = 0")
    copy = str(tmp_path / "b.db")
    shutil.copy(path, copy)
    shutil.copy(path + "-wal", copy + "-wal")
    rows = db.execute("SELECT * FROM t ORDER BY id").fetchall()
    yield copy, rows
    db.close()


def plain_checksum(data, seed):
    s1, s2 = seed
    for x, y in struct.iter_unpack("<2I", data):
        s1 = (s1 + x + s2) & 0xFFFFFFFF
        s2 = (s2 + y + s1) & 0xFFFFFFFF
    return s1, s2


@pytest.mark.parametrize("n", [8, 16, 1032, 4104])
def test_checksum(n):
    data = bytes((k * 37 + 11) % 256 for k in range(n))
    for seed in ((0, 0), (4294967295, 123456789)):
        assert checksum(data, seed) == plain_checksum(data, seed)
    with pytest.raises(ValueError):
        checksum(b"abc")


def test_log_rebuilds_the_database(spark, database, tmp_path):
    path, rows = database
    head = wal.header(path + "-wal")
    assert head["page_size"] == 1024
    found = wal.frames(spark, path + "-wal", frames_per_partition=16)
    valid = wal.valid_frames(found, head)
    assert valid.count() == found.count() > 32
    made = sorted(wal.committed_pages(valid).collect())
    out = tmp_path / "c.db"
    out.write_bytes(b"".join(bytes(r.data) for r in made))
    assert [r.pg_no for r in made] == list(range(1, len(made) + 1))
    assert sqlite3.connect(out).execute("SELECT * FROM t ORDER BY id").fetchall() == rows


def test_damage_ends_the_log(spark, database):
    path, _ = database
    raw = bytearray(open(path + "-wal", "rb").read())
    raw[wal.HEADER + 10 * (wal.FRAME_HEADER + 1024) + 500] ^= 1
    open(path + "-wal", "wb").write(raw + b"partial")
    found = wal.frames(spark, path + "-wal")
    assert sorted(r.frame_no for r in wal.valid_frames(found, wal.header(path + "-wal")).collect()) == list(range(1, 11))


def test_encoded_frames_are_valid(spark, tmp_path):
    raw = wal.encode_header(512, 7, 9)
    seed = struct.unpack(">2I", raw[24:])
    for k in range(1, 4):
        frame = wal.encode_frame(k, 3 if k == 3 else 0, 7, 9, bytes([k]) * 512, seed)
        seed, raw = struct.unpack(">2I", frame[16:24]), raw + frame
    path = tmp_path / "x-wal"
    path.write_bytes(raw)
    assert wal.valid_frames(wal.frames(spark, str(path)), wal.header(str(path))).count() == 3


def test_offsets():
    assert [wal.classify_offset(x, 1024) for x in (0, 32, 56, 1080)] == ["header", "frame_header", "frame_data", "frame_header"]
    with pytest.raises(ValueError):
        wal.classify_offset(40, 1024)


def test_pages(spark, database, tmp_path):
    path, rows = database
    db = sqlite3.connect(path)
    db.execute("PRAGMA wal_checkpoint(TRUNCATE)")
    db.close()
    a = pages.pages(spark, path, per_task=7)
    raw = open(path, "rb").read()
    assert a.count() == len(raw) // 1024
    assert pages.page_hex(a, 2) == raw[1024:2048].hex()
    with pytest.raises(NotFoundError, match="not found"):
        pages.page_hex(a, 10_000)
    changed = bytearray(raw[:-1024])
    changed[1024 + 5] ^= 1
    changed[1024 + 9] ^= 1
    other = tmp_path / "other.db"
    other.write_bytes(changed)
    n = len(raw) // 1024
    assert sorted(map(tuple, pages.diff(a, pages.pages(spark, str(other))).collect())) == [(2, "differ", 2, 5), (n, "only_a", None, None)]
    snap = tmp_path / "snap"
    snap.write_bytes(pages.snapshot_header(42) + raw)
    last, got = pages.read_snapshot(spark, str(snap))
    assert last == 42 and pages.diff(a, got).count() == 0
    assert a.where("pg_no = 1").select(pages.hex_window(a.data).alias("h")).first().h == raw[:16].hex()
    for bad in (b"", pages.snapshot_header(1), pages.snapshot_header(1) + raw[:-5], b"\0" * 16 + raw):
        snap.write_bytes(bad)
        with pytest.raises(ValueError):
            pages.read_snapshot(spark, str(snap))


@pytest.mark.parametrize(("field", "size"), [(1, 65536), (512, 512), (4096, 4096), (32768, 32768), (0, None), (1000, None)])
def test_page_sizes(field, size):
    raw = bytearray(100)
    struct.pack_into(">H", raw, 16, field)
    if size:
        assert pages.page_size(bytes(raw)) == size
    else:
        with pytest.raises(ValueError):
            pages.page_size(bytes(raw))
    with pytest.raises(ValueError):
        pages.page_size(bytes(raw[:99]))


def test_entries(spark):
    raw = entry.encode("id-1", [(1, b"abc"), (300, b"\0" * 200)], 300)
    assert entry.decode(raw) == {"id": "id-1", "n_truncate": 300, "pages": [{"pg_no": 1, "data": b"abc"}, {"pg_no": 300, "data": b"\0" * 200}]}
    log = spark.createDataFrame([(3, 1, 0, bytearray(raw), None, 0), (4, 1, 2, None, None, 0)], "idx long, term long, type int, data binary, extensions binary, appended_at long")
    got = entry.entries(log).collect()
    assert [(r.idx, r.id, r.n_truncate, [p.pg_no for p in r.pages]) for r in got] == [(3, "id-1", 300, [1, 300])]
    assert entry.problem(entry.decode(raw)) is None
    assert [entry.problem(x) for x in (None, entry.decode(entry.encode("a", [], 1)), entry.decode(entry.encode("a", [(1, b"x")], 0)), entry.decode(entry.encode("a", [(0, b"x")], 1)))] == ["no pages", "no pages", "no commit", "empty page"]
    with pytest.raises(ValueError):
        entry.decode(raw[:-1])
