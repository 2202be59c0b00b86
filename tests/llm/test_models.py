"""Quality and toxicity: base rules against plain versions, monotone trees, held-out accuracy."""

import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from logfold.llm import gbt, quality, toxicity

SF = "/root/testdata/sf0.1"
WORD = r"[^\x20\x09-\x0D]+"


def plain(text):
    words = re.findall(WORD, text)
    grams = Counter(zip(words, words[1:], words[2:]))
    covered = {k + j for k in range(len(words) - 2) if grams[tuple(words[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab# |\n\té\xa0\x1c", max_size=60))
def test_base_counts(text):
    assert quality.statistics(text)[0] == plain(text)


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "a " * 200_000, 5), (None, "b", 5)], "doc_id long, text string, kept int")
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    forest = quality.train(docs, empty)
    out = {r.doc_id: r for r in quality.judge(docs, forest).collect()}
    assert len(out) == 4 and all(r.base_failed and not r.kept for r in out.values()) and out[3].n_repeat_words == 200_000
    assert quality.keep_documents(docs, forest).columns == docs.columns
    assert [r.grade for r in toxicity.score(docs, toxicity.train(docs, empty)).collect()] == [0] * 4


def test_constrained_features_only_lower_the_score():
    r = np.random.default_rng(0)
    x = r.random((600, 3))
    y = (x[:, 0] + 0.3 * r.standard_normal(600) < 0.5).astype(float)
    f = gbt.fit(x, y, np.array([-1, 0, 1]))
    probe = r.random((200, 3))
    for j, sign in ((0, -1), (2, 1)):
        up = probe.copy()
        up[:, j] += r.random(200)
        assert (sign * (f.score(up) - f.score(probe)) >= -1e-12).all()


@pytest.fixture(scope="module")
def labelled(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    held = labels.where("doc_id % 3 = 0")
    return docs, labels.where("doc_id % 3 <> 0"), {r.doc_id: r for r in held.collect()}


def test_quality_held_out(labelled):
    docs, seen, held = labelled
    out = [r for r in quality.judge(docs, quality.train(docs, seen)).collect() if r.doc_id in held and not r.base_failed]
    good = [r.kept for r in out if held[r.doc_id].quality]
    bad = [r.kept for r in out if not held[r.doc_id].quality]
    assert np.mean(good) > 0.995 and np.mean(bad) < 0.05


def test_toxicity_held_out(labelled):
    docs, seen, held = labelled
    out = [r for r in toxicity.score(docs, toxicity.train(docs, seen)).collect() if r.doc_id in held]
    assert np.mean([r.toxic for r in out if held[r.doc_id].toxic]) > 0.9
    assert np.mean([r.toxic for r in out if not held[r.doc_id].toxic]) < 0.01
    assert all(0 <= r.severity <= toxicity.GRADES - 1 for r in out)
