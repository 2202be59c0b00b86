"""Dialect rewrites, column functions, the engine and the shell, with sqlite3 as the judge."""

import io
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from logfold import cli, dialect
from logfold.engine import Engine
from logfold.functions import sqlite as S
from logfold.model import ConstraintError, InvalidChangeError, StaleBaseError


def test_splitter():
    text = "SELECT ';'; -- a; b\nSELECT 1 /* ; */;CREATE TRIGGER x AFTER INSERT ON t BEGIN SELECT CASE WHEN 1 THEN 2 END; END; SELECT 2"
    assert len(dialect.statements(text)) == 4
    assert dialect.complete("SELECT 1;") and not dialect.complete("SELECT 1") and not dialect.complete("SELECT 'a;") and not dialect.complete("")


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT 1.5 * 2 AS x",
        "SELECT iif(1 > 2, 'a', 'b') AS x, ifnull(NULL, 3) AS y",
        "SELECT 'ABC' LIKE 'abc' AS x, 'a' IS NOT NULL AS y, 1 IS NOT 2 AS z, NULL IS NULL AS w",
        "SELECT x FROM (SELECT 1 AS x UNION ALL SELECT 2 UNION ALL SELECT 3) ORDER BY x LIMIT 1, 1",
        "SELECT substr('hello', 0, 3) AS x, substr('hello', 2, 2) AS y, substr('hello', -3) AS z",
        "SELECT round(2.5) AS x, max(1, NULL) AS y, max(3, 1, 2) AS z, min(3, 1) AS w",
        "SELECT total(x) AS t FROM (SELECT 1 AS x UNION ALL SELECT NULL)",
        "SELECT total(x) AS t FROM (SELECT 1 AS x) WHERE x > 5",
        "SELECT 1 AS a UNION SELECT 2 INTERSECT SELECT 2",
        "WITH q AS (SELECT 3 AS a) SELECT a FROM q UNION SELECT 2 INTERSECT SELECT 2 ORDER BY 1",
        "SELECT 'it''s LIKE; iif(1,2,3)' AS x",
        "SELECT 'A' = 'a' COLLATE NOCASE AS x",
        """SELECT '{"a": "q"}' ->> '$.a' AS x, json_extract('{"a": "q"}', '$.a') AS y""",
        "SELECT 1 == 1 AS x, 'a' || NULL AS y, -7 % 3 AS z",
    ],
)
def test_queries_equal_sqlite(spark, sql):
    plain = lambda v: int(v) if isinstance(v, bool) else v
    assert [tuple(map(plain, r)) for r in spark.sql(dialect.translate(sql)).collect()] == sqlite3.connect(":memory:").execute(sql).fetchall()


def test_column_functions_equal_sqlite(spark):
    db = sqlite3.connect(":memory:")
    one = lambda sql: db.execute(f"SELECT {sql}").fetchone()[0]
    cases = {
        "7/2": S.integer_division(F.lit(7), F.lit(2)),
        "-7/2": S.integer_division(F.lit(-7), F.lit(2)),
        "1/0": S.integer_division(F.lit(1), F.lit(0)),
        "7.0/2": S.division(F.lit(7.0), F.lit(2)),
        "CAST('12abc' AS INTEGER)": S.to_integer(F.lit("12abc")),
        "CAST('abc' AS INTEGER)": S.to_integer(F.lit("abc")),
        "9223372036854775807+1": S.add(F.lit(9223372036854775807), F.lit(1)),
        "round(2.5)": S.round_real(F.lit(2.5)),
        "max(1, NULL)": S.scalar_max(F.lit(1), F.lit(None).cast("int")),
        "min(4, 2)": S.scalar_min(F.lit(4), F.lit(2)),
        "'ABC' LIKE 'a_c'": S.like(F.lit("ABC"), "a_c"),
        "'a.c' GLOB 'a.?'": S.glob(F.lit("a.c"), "a.?"),
        "'abc' GLOB 'a.?'": S.glob(F.lit("abc"), "a.?"),
        "'xbc' GLOB '[a-x]*'": S.glob(F.lit("xbc"), "[a-x]*"),
        "quote('it''s')": S.quote(F.lit("it's")),
        "quote(NULL)": S.quote(F.lit(None).cast("string")),
        "zeroblob(3)": S.zeroblob(3),
    }
    for start in (-7, -3, -1, 0, 1, 2, 9):
        for n in (None, -2, 0, 1, 3, 9):
            cases[f"substr('hello', {start}{'' if n is None else f', {n}'})"] = S.substr(F.lit("hello"), start, n)
    got = spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(cases.values())]).first()
    assert [bytes(v) if isinstance(v, bytearray) else v for v in got] == [one(sql) for sql in cases]
    assert len(spark.range(1).select(S.seeded_blob(50, F.lit(1)).alias("b")).first().b) == 50
    assert spark.createDataFrame([(2, "b"), (1, "a"), (3, None)], "k int, v string").agg(S.group_concat("v", "k")).first()[0] == "a,b"


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, str(tmp_path), buckets=2)


SCRIPT = """
CREATE TABLE t(id INTEGER PRIMARY KEY, v TEXT NOT NULL, n INTEGER NOT NULL DEFAULT 0);
CREATE INDEX i ON t(v);
INSERT INTO t(id, v) VALUES (1, 'a'), (2, 'b'), (3, 'c;d');
INSERT OR REPLACE INTO t VALUES (2, 'B', 5);
INSERT INTO t(id, v) VALUES (1, 'z'), (9, 'i') ON CONFLICT(id) DO UPDATE SET v = excluded.v, n = n + 1;
INSERT INTO t(id, v) VALUES (1, 'zz') ON CONFLICT(id) DO NOTHING;
UPDATE t SET v = v || 'x', n = n + 10 WHERE id IN (SELECT id FROM t WHERE n < 5);
DELETE FROM t WHERE id BETWEEN 3 AND 4;
INSERT INTO t(v) SELECT v || '!' FROM t WHERE id = 2;
"""


def test_script_equals_sqlite(engine):
    db = sqlite3.connect(":memory:")
    db.executescript(SCRIPT)
    engine.script(SCRIPT)
    for q in ("SELECT * FROM t ORDER BY id", "SELECT count(*) FROM t", "SELECT coalesce(max(n), 0) + 1 FROM t WHERE id > 100"):
        assert list(map(tuple, engine.execute(q).collect())) == db.execute(q).fetchall()
    assert list(map(tuple, engine.execute("SELECT v FROM t WHERE id = ?", [2]).collect())) == [("B",)]
    with pytest.raises(ConstraintError):
        engine.execute("INSERT INTO t(id, v) VALUES (1, 'again')")
    with pytest.raises(ConstraintError):
        engine.execute("INSERT INTO t(id, v) VALUES (50, NULL)")
    assert engine.tables() == ["t"] and "v TEXT NOT NULL" in engine.schema("t")
    assert engine.execute("PRAGMA integrity_check").first()[0] == "ok"


def test_transactions(engine):
    engine.script("CREATE TABLE t(id INTEGER PRIMARY KEY, v TEXT); INSERT INTO t VALUES (1, 'a'), (2, 'b')")
    rows = lambda: sorted(map(tuple, engine.execute("SELECT * FROM t").collect()))
    engine.script("BEGIN; UPDATE t SET v = 'x'; DELETE FROM t WHERE id = 1; INSERT INTO t VALUES (3, 'c')")
    assert rows() == [(2, "x"), (3, "c")] and engine.table("t").version == 1
    engine.execute("ROLLBACK")
    assert rows() == [(1, "a"), (2, "b")]
    engine.script("BEGIN IMMEDIATE; UPDATE t SET v = 'x' WHERE id = 1; DELETE FROM t WHERE id = 2; COMMIT")
    assert rows() == [(1, "x")] and engine.table("t").version == 2
    with pytest.raises(InvalidChangeError):
        engine.execute("COMMIT")


SCHEMA = """
CREATE TABLE rec(id INTEGER PRIMARY KEY AUTOINCREMENT, name TEXT NOT NULL, rev INTEGER NOT NULL, at INTEGER NOT NULL, gone INTEGER, tag TEXT, body BLOB, UNIQUE(name, rev));
CREATE TABLE todo(id INTEGER PRIMARY KEY AUTOINCREMENT, what TEXT NOT NULL, rec_id INTEGER NOT NULL, due INTEGER NOT NULL DEFAULT 0);
CREATE TRIGGER grows BEFORE INSERT ON rec FOR EACH ROW BEGIN
  SELECT CASE WHEN NEW.rev < (SELECT max(rev) FROM rec WHERE name = NEW.name) THEN RAISE(ABORT, 'a rev may not fall') END; END;
CREATE TRIGGER newest AFTER INSERT ON rec BEGIN UPDATE rec SET gone = NEW.at WHERE gone IS NULL AND name = NEW.name AND rev < NEW.rev; END;
CREATE TRIGGER told AFTER INSERT ON rec BEGIN INSERT INTO todo(what, rec_id) VALUES ('put', NEW.id); END;
CREATE TRIGGER told_gone AFTER INSERT ON rec WHEN NEW.gone IS NOT NULL BEGIN INSERT INTO todo(what, rec_id, due) VALUES ('out', NEW.id, NEW.gone); END;
CREATE TRIGGER told_tag AFTER UPDATE ON rec WHEN NEW.tag IS NOT OLD.tag OR NEW.body IS NOT OLD.body BEGIN INSERT INTO todo(what, rec_id) VALUES ('set', NEW.id); END;
CREATE TRIGGER told_out AFTER UPDATE OF gone ON rec WHEN NEW.gone IS NOT NULL AND OLD.gone IS NULL BEGIN INSERT INTO todo(what, rec_id, due) VALUES ('out', NEW.id, NEW.gone); END;
CREATE TRIGGER forget AFTER DELETE ON rec BEGIN DELETE FROM todo WHERE rec_id = OLD.id; END;
"""


def test_triggers_equal_sqlite(engine):
    """A random workload on records with an outbox: the same rows in both tables after every statement."""
    r, db = random.Random(5), sqlite3.connect(":memory:")
    db.executescript(SCHEMA)
    engine.script(SCHEMA)
    names: list[str] = []
    for clock, kind in enumerate(("new", "bump", "tag", "soft", "bump", "drain"), 1):
        name = r.choice(names) if names else ""
        if kind == "new":
            names.append(f"n{len(names)}")
            sql, args = "INSERT INTO rec(name, rev, at, tag, body) VALUES (?, 1, ?, ?, ?)", [names[-1], clock, "t", b"{}"]
        elif kind == "bump":
            sql, args = "INSERT INTO rec(name, rev, at, tag, body) SELECT ?, coalesce(max(rev), 0) + 1, ?, ?, ? FROM rec WHERE name = ?", [name, clock, "u", b"[]", name]
        elif kind == "soft":
            sql, args = "UPDATE rec SET gone = ? WHERE name = ? AND gone IS NULL", [clock, name]
        elif kind == "tag":
            sql, args = "UPDATE rec SET tag = ? WHERE name = ?", [f"t{clock % 2}", name]
        else:
            sql, args = "DELETE FROM rec WHERE id IN (SELECT rec_id FROM todo WHERE what = 'out' AND due <= ?)", [clock]
        done = db.execute(sql, args)
        engine.execute(sql, args)
        assert engine.changes == done.rowcount
    for q in ("SELECT name, rev, at, gone, tag, body FROM rec ORDER BY name, rev", "SELECT what, name, rev, due FROM todo JOIN rec ON rec.id = rec_id ORDER BY 1, 2, 3, 4", "SELECT count(*) FROM todo"):
        assert list(map(tuple, engine.execute(q).collect())) == db.execute(q).fetchall()
    before = engine.table("rec").version, engine.table("todo").version
    with pytest.raises(ConstraintError, match="a rev may not fall"):
        engine.execute("INSERT INTO rec(name, rev, at) VALUES (?, -1, 99)", [db.execute("SELECT name FROM rec LIMIT 1").fetchone()[0]])
    assert before == (engine.table("rec").version, engine.table("todo").version)
    assert engine.execute("SELECT count(*) FROM sqlite_master WHERE type = 'trigger' AND tbl_name = 'rec'").first()[0] == 7
    engine.script("DROP TRIGGER forget; DROP TABLE todo")
    assert engine.tables() == ["rec"] and "forget" not in engine.schema("rec")


def test_savepoints_and_two_tables(engine):
    engine.script("CREATE TABLE a(id INTEGER PRIMARY KEY, v TEXT); CREATE TABLE b(id INTEGER PRIMARY KEY, v TEXT); INSERT INTO a VALUES (1, 'x')")
    rows = lambda t: sorted(map(tuple, engine.execute(f"SELECT * FROM {t}").collect()))
    engine.script("BEGIN IMMEDIATE; INSERT INTO a VALUES (2, 'y'); SAVEPOINT s; INSERT INTO b VALUES (1, 'z'); DELETE FROM a; ROLLBACK TO s; INSERT INTO b VALUES (7, 'w'); RELEASE s; COMMIT")
    assert rows("a") == [(1, "x"), (2, "y")] and rows("b") == [(7, "w")]
    engine.execute("BEGIN")
    engine.execute("INSERT INTO a VALUES (3, 'q')")
    with pytest.raises(ConstraintError):
        engine.execute("INSERT INTO a VALUES (1, 'again')")  # a key that is there, inside a transaction
    engine.execute("COMMIT")
    assert rows("a") == [(1, "x"), (2, "y"), (3, "q")]
    engine.execute("INSERT INTO a(v) VALUES ('n'), ('m')")
    assert engine.changes == 2 and engine.execute("SELECT changes() AS c, last_insert_rowid() AS r").first() == (2, 5)


def test_a_lost_race_leaves_no_table_changed(engine, spark):
    engine.script("CREATE TABLE a(id INTEGER PRIMARY KEY, v TEXT); CREATE TABLE b(id INTEGER PRIMARY KEY, v TEXT)")
    engine.script("BEGIN IMMEDIATE; INSERT INTO a VALUES (1, 'x'); INSERT INTO b VALUES (1, 'x')")
    Engine(spark, engine.root).execute("INSERT INTO b VALUES (5, 'other')")
    with pytest.raises(StaleBaseError):
        engine.execute("COMMIT")
    assert engine.execute("SELECT count(*) FROM a").first()[0] == 0 and engine.execute("SELECT id FROM b").first()[0] == 5
    engine.execute("INSERT INTO a VALUES (9, 'later')")  # over what was given up
    assert engine.execute("SELECT id FROM a").first()[0] == 9


def test_shell(engine, tmp_path):
    shell, out = cli.Shell(engine), io.StringIO()
    (tmp_path / "s.sql").write_text("CREATE TABLE u(id INTEGER PRIMARY KEY, b BLOB); INSERT INTO u VALUES (1, x'ff00'), (2, NULL);")
    shell.run([f".load {tmp_path}/s.sql", ".tables", "SELECT id,", " b FROM u ORDER BY id;", "nonsense;", ".servers", ".what", "SELECT 'a", "b;' AS x;", ".quit", "SELECT 9;"], out)
    said = out.getvalue()
    assert "<blob 2 bytes>" in said and "NULL" in said and "Error:" in said and "no voters" in said and "unknown command" in said and "9" not in said
    assert cli.format_table(None) == "OK"
    sink = cli.LineSink(2)
    sink.write("a\nb\nc\nd")
    assert list(sink.lines) == ["b", "c"]
    members = [("n2", "b"), ("n1", "a"), ("n3", "c")]
    assert cli.members_to_tell(members, "n1", "a2") == ["b", "c"] and cli.members_to_tell(members, "n1", "a") == [] == cli.members_to_tell(members, "n9", "x")
