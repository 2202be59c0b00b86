"""The pipeline's stages on a small table, each against a plain version on its own input."""

import pytest

import corpus_pipeline as C
from logfold.llm import packing, pii, quality
from tests.llm.test_lines import brute as brute_lines
from tests.llm.test_near import brute as brute_near

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.toPandas()]
    for name, f in C.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        f(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs.toPandas())
    return out


def test_columns_stay(stages):
    assert all(list(x.columns) == list(stages[0].columns) for x in stages[1:5])


def test_quality(spark, stages):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    forest = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    kept = set()
    for d, t in zip(stages[0].doc_id, stages[0].text):
        counts, features = quality.statistics(t)
        score = forest.score(quality.np.array([features]))[0]
        if counts[0] >= 50 and 2 * counts[4] <= counts[0] and score >= 0:
            kept.add(d)
    assert set(stages[1].doc_id) == kept and 0 < len(kept) < len(stages[0])


def test_lines(stages):
    got = sorted(zip(stages[2].doc_id, stages[2].text))
    assert got == brute_lines(list(zip(stages[1].doc_id.tolist(), stages[1].text.tolist())))


def test_near_duplicates(stages):
    classes = brute_near(list(zip(stages[2].doc_id.tolist(), stages[2].text.tolist())))
    assert set(stages[3].doc_id) == {d for d, least in classes.items() if d == least}


def test_near_copies_are_caught(spark):
    """Of planted copies with a few words changed (a similarity of 0.8 or more), nine in ten and more go."""
    import random

    r = random.Random(6)
    rows = []
    for k in range(60):
        words = [f"w{r.randrange(3000)}" for _ in range(200)]
        rows.append((k, " ".join(words)))
        for c in range(3):
            other = list(words)
            for _ in range(r.randint(0, 4)):
                other[r.randrange(200)] = f"x{k}{c}"
            rows.append((1000 + 3 * k + c, " ".join(other)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {x.doc_id for x in C.near_stage(spark, docs, "").select("doc_id").collect()}
    assert kept >= set(range(60)) and len(kept) - 60 <= 18


def test_empty_and_odd_tables(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    rows = [(None, None, None, None, None), (1, None, "en", "a", 0), (1, "", "en", "a", 0), (2, "a b c", None, "a", 5), (2, "a b c", None, "a", 5), (None, "d " * 80 + "e", "en", "b", 1)]
    for data, n in (([], 0), (rows, None)):
        docs = spark.createDataFrame(data, schema)
        for name, f in C.STAGES:
            before = docs
            docs = f(spark, docs, SF)
            assert name == "packing" or docs.columns == before.columns
        assert n is None or docs.count() == n
        docs.collect()


def test_personal_data(stages):
    before = dict(zip(stages[3].doc_id, stages[3].text))
    assert set(before) == set(stages[4].doc_id)
    for d, t, n in zip(stages[4].doc_id, stages[4].text, stages[4].n_chars):
        assert n == len(t) and not [x for x in pii.base_spans(t)] and (t == before[d]) == (not pii.base_spans(before[d]) and not pii.hidden_spans(before[d], []))


def test_packing(stages):
    out, docs = stages[5], stages[4]
    path = packing.default_vocabulary()
    assert out.groupby("doc_id").length.sum().to_dict() == {d: len(packing.tokens.encode(t, path)) // 4 + 1 for d, t in zip(docs.doc_id, docs.text)}
    assert out.groupby("sequence_id").length.sum().max() <= 2048
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]]
