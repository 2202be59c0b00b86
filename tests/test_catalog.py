"""Every named query against its SQL in DuckDB, on the small tables, and ordered operators over many segments."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from logfold.operators import joins, log, ordered, rows
from logfold.plans import catalog, statements  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(rows):
    fix = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted((tuple(map(fix, r)) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    want = duck.execute(catalog.ORACLES[name])
    order = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(order)
    assert plain(df.select(*order).collect()) == plain(want.fetchall())


def test_segments_carry_over(spark):
    rows = [(k, k % 3 == 0) for k in range(0, 500) if k % 17 and not 100 < k < 180]
    df = spark.createDataFrame(rows, "idx long, c boolean")
    got = {r.idx: (r.s, r.p) for r in ordered.previous(ordered.running_sum_before(df, "idx", F.col("c").cast("int"), "s", width=20), "idx", "p", width=20).collect()}
    total, before, want = 0, None, {}
    for k, c in rows:
        want[k] = (total, before)
        total, before = total + c, k
    assert got == want
    missing = {x for r in log.gaps(df, "idx", width=20).collect() for x in range(r.gap_start, r.gap_end + 1)}
    assert missing == set(range(1, 500)) - {k for k, _ in rows}


def test_empty_log(spark):
    empty = spark.createDataFrame([], "idx long")
    assert tuple(log.bounds(empty, "idx").first()) == (0, 0) and log.gaps(empty, "idx").count() == 0


def test_scans_push_down(spark, tmp_path):
    plan = catalog.QUERIES["as_of_version"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(event_id,500)" in plan and "props" not in plan and "CartesianProduct" not in plan


def test_catalog_lists_the_folder(spark, tmp_path):
    assert [r.name for r in catalog.QUERIES["catalog"](spark, SF).collect()] == sorted(os.path.basename(p)[:-8] for p in glob.glob(f"{SF}/*.parquet"))
    assert catalog.QUERIES["catalog"](spark, str(tmp_path)).count() == 0
    for name in ("b.parquet", "a.parquet", "notes.txt", ".hidden.parquet"):
        (tmp_path / name).mkdir()
    assert [r.name for r in catalog.QUERIES["catalog"](spark, str(tmp_path)).collect()] == ["a", "b"]


def test_the_last_change_of_a_key_counts(spark):
    base = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "k long, v string, n long")
    changes = spark.createDataFrame([(1, "x", 2), (1, "y", 1), (3, "z", 1)], "k long, v string, n long")
    assert sorted(map(tuple, rows.upsert(base, changes, "k", "n").collect())) == [(1, "x", 2), (2, "b", 0), (3, "z", 1)]


def test_range_join_equals_a_loop(spark):
    import random

    r = random.Random(3)
    points = [(k, None if k % 19 == 0 else r.uniform(-50, 50)) for k in range(120)]
    spans = [(k, a := r.uniform(-60, 60), a + r.choice([-1, 0, 0.01, 1, 7, 40, 200])) for k in range(60)]
    got = joins.range_join(spark.createDataFrame(points, "p long, x double"), spark.createDataFrame(spans, "s long, a double, b double"), "x", "a", "b")
    assert sorted((g.p, g.s) for g in got.collect()) == sorted((p, s) for p, x in points for s, a, b in spans if x is not None and a <= x < b)


def test_upsert_replace_keeps_changes_that_share_a_key(spark, duck, tmp_path):
    """Beyond a million keys the two kinds of change meet: key 1,000,007 is changed to Z and inserted as N."""
    path = str(tmp_path / "orders.parquet")
    duck.execute(f"COPY (SELECT o_orderkey + shift AS o_orderkey, o_orderstatus FROM orders, (VALUES (0), (999996)) s(shift) UNION ALL SELECT NULL, o_orderstatus FROM orders WHERE o_orderkey = 7) TO '{path}' (FORMAT parquet)")
    want = duck.execute(catalog.ORACLES["upsert_replace"].replace("FROM orders", f"FROM read_parquet('{path}')")).fetchall()
    keys = [k for k, _ in want]
    assert len(keys) > len(set(keys)) and None not in keys
    assert plain(catalog.QUERIES["upsert_replace"](spark, str(tmp_path)).collect()) == plain(want)
