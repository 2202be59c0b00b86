"""Exact search against a plain version, with ties, nulls and blocks smaller than the table."""

import math
import random

import pytest

from logfold.llm import topk


def plain(rows, k, every):
    good = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in good:
        if q % every == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def run(spark, rows, k=5, every=4, block=64):
    df = spark.createDataFrame([(i, v, i, 0) for i, v in rows], "vec_id long, embedding array<double>, ids long, side int")
    return sorted(map(tuple, topk.search(df, k=k, every=every, block=block).collect()))


@pytest.mark.parametrize("block", [3, 50])
def test_equals_plain(spark, block):
    r = random.Random(block)
    rows = [(i, [r.choice([-1.0, 0.0, 0.5, 1.0, r.gauss(0, 1)]) for _ in range(40)]) for i in range(90)]
    rows += [(100 + i, [0.5] * 40) for i in range(20)]
    rows += [(200, None), (204, [1.0, None]), (208, [float("nan")] * 8), (212, [float("inf")] * 8), (None, [1.0] * 8), (216, [1.0, 2.0])]
    assert run(spark, rows, block=block) == plain([(i, v and v + [0.0] * (40 - len(v))) for i, v in rows], 5, 4)


def test_few_rows_and_none(spark):
    assert run(spark, []) == []
    assert run(spark, [(4, [1.0])]) == []
    assert run(spark, [(4, [1.0]), (5, [1.0])]) == [(4, 1, 5, 4096)]


def test_tasks_do_not_grow_with_the_rows():
    for rows in (1, 10**4, 10**7, 10**9, 10**12):
        q, c = topk.grid(-(-rows // 20 // topk.BLOCK), -(-rows // topk.BLOCK))
        assert c <= topk.TASKS and (q > topk.TASKS or q * c <= topk.TASKS)


def test_bounds_keep_ties(spark):
    rows = [(i, [1.0, 0.0]) for i in range(40)] + [(40 + i, [0.0, float(i % 3)]) for i in range(40)]
    assert run(spark, rows, block=7) == plain(rows, 5, 4)
