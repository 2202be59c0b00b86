"""Suffix dedup against brute force."""

import random
import time
from collections import Counter

import pytest

from logfold.llm import suffixes


def brute(rows, length):
    raws = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(r[k : k + length] for _, r in raws for k in range(len(r) - length + 1))
    out = []
    for d, r in raws:
        gone = [False] * len(r)
        for k in range(len(r) - length + 1):
            if seen[r[k : k + length]] > 1:
                gone[k : k + length] = [True] * length
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((d, len(r), sum(gone), spans, bytes(b for b, g in zip(r, gone) if not g)))
    return sorted(out, key=str)


def sample(seed, n=60):
    r = random.Random(seed)
    text = lambda k: "".join(r.choice("abcdé ") for _ in range(k))
    stock = [text(r.randint(150, 700)) for _ in range(8)]
    rows = []
    for d in range(n):
        parts = []
        for _ in range(r.randint(0, 4)):
            s = r.choice(stock)
            a = r.randint(0, len(s) - 1)
            parts += [s[a : a + r.randint(50, 600)], text(r.randint(0, 90))]
        rows.append((d, "".join(parts)))
    return rows + [(1000, None), (1001, ""), (1002, "x" * 199), (1003, "y" * 200), (1004, "z" * 201), (1005, "w " * 700), (1006, stock[0]), (1006, stock[0]), (None, stock[1]), (None, None)]


@pytest.mark.parametrize(("seed", "group", "lot"), [(1, 2048, 2_000_000), (2, 3, 2000)])
def test_equals_brute_force(spark, seed, group, lot):
    rows = sample(seed)
    docs = spark.createDataFrame([(t, d, 1, "q") for d, t in rows], "text string, doc_id long, first int, copy string")
    out = sorted((tuple(r[:4]) + (bytes(r.kept),) for r in suffixes.dedup(docs, group=group, lot=lot).collect()), key=str)
    assert out == brute(rows, 200)


def test_rows_that_share_an_id_take_linear_time(spark):
    r = random.Random(4)
    line = "".join(r.choice("abcdefgh ") for _ in range(260))
    rows = [(None, "".join(r.choice("abcdefgh ") for _ in range(300)) + (line if k % 2 else "")) for k in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    began = time.time()
    out = suffixes.dedup(docs).collect()
    assert Counter(x.n_removed >= 260 for x in out) == {True: 750, False: 750}
    assert time.time() - began < 20


def test_repeated_windows():
    r = random.Random(3)
    strings = [bytes(r.choice(b"ab") for _ in range(r.randint(0, 80))) for _ in range(40)]
    strings += [s[3:] + b"a" for s in strings[:10]]
    seen = Counter(s[k : k + 16] for s in strings for k in range(len(s) - 15))
    assert [x.tolist() for x in suffixes.repeated(strings, 16)] == [[k for k in range(len(s) - 15) if seen[s[k : k + 16]] > 1] for s in strings]


def test_empty_table(spark):
    assert suffixes.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
