"""Near-duplicate documents against brute-force Jaccard similarity."""

import random

import corpus_pipeline
from logfold.llm import near, simhash


def grams(text, n=5):
    words = (text or "").lower().split()
    return {tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))}


def brute(rows, similarity=0.8):
    """doc_id -> smallest doc_id of its component."""
    sets = [grams(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= similarity * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for k, (d, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), d), d)
    return {d: least[find(k)] for k, (d, _) in enumerate(rows)}


def varied(seed, n):
    """Texts with 0 to 6 words of a base changed: similarities from 1 to about 0.6."""
    r = random.Random(seed)
    base = [[f"w{r.randrange(500)}" for _ in range(r.choice([30, 120, 300]))] for _ in range(25)]
    out = [(5001, None), (5002, ""), (5003, " \n"), (5004, "one two"), (5005, "One  two"), (5006, "one two three")]
    for k in range(n):
        words = list(r.choice(base))
        for _ in range(r.randint(0, 6)):
            words[r.randrange(len(words))] = f"x{k}"
        out.append((4000 - k, " ".join(words)))
    return out


def test_near_documents_equal_brute_force(spark):
    rows = varied(4, 250)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    for size in (2048, 5):  # whole groups, and groups cut into blocks
        assert {r.doc_id: r.component_id for r in near.near_documents(docs, size=size).collect()} == want


def test_bands_find_pairs_at_the_threshold():
    r = random.Random(9)
    found = total = 0
    while total < 300:
        words = [f"w{r.randrange(2000)}".encode() for _ in range(120)]
        other = list(words)
        for _ in range(2):
            other[r.randrange(5, 115)] = b"x%d" % r.randrange(2000)
        a, b = near.shingles(words), near.shingles(other)
        both = len(set(a.tolist()) & set(b.tolist()))
        if 0.8 <= both / (len(a) + len(b) - both) < 0.87:
            total += 1
            found += any(x == y for x, y in zip(near.bands(a), near.bands(b)))
    assert found >= 298


def test_the_stage_drops_a_copy_with_two_words_changed(spark):
    words = [f"w{k}" for k in range(120)]
    other = words[:40] + ["x"] + words[41:80] + ["y"] + words[81:]
    rows = [(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(words[:60])), (None, " ".join(words))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id or 0 for r in corpus_pipeline.near_stage(spark, docs, "").collect()) == [1, 3]


def test_the_stage_keeps_other_texts_of_a_repeated_id(spark):
    words = lambda a: " ".join(f"w{k}" for k in range(a, a + 60))
    rows = [(1, words(0)), (1, words(100)), (1, words(100)), (2, words(100)), (None, words(200)), (None, words(300)), (None, words(300))]
    docs = spark.createDataFrame([(t, d, 1, "x") for d, t in rows], "text string, doc_id long, doc int, `copy` string")
    out = corpus_pipeline.near_stage(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in out.collect()) == sorted([(1, words(0)), (1, words(100)), (0, words(200)), (0, words(300))])


def test_hot_bucket_by_pivots(spark):
    base = [f"w{k}" for k in range(80)]
    rows = [(d, " ".join(base[:d] + [f"x{d}"] + base[d + 1 :])) for d in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near.near_documents(docs, size=6, pivots=2).collect()} == brute(rows)


def test_simhash_classes_are_candidates(spark, monkeypatch):
    """Without MinHash's groups, texts are linked where the SimHash grid join finds them and their similarity allows it."""
    r = random.Random(3)
    rows, close = [], set()
    for k in range(12):
        words = [f"w{r.randrange(2000)}" for _ in range(300)]
        other = list(words)
        other[r.randrange(300)] = "x"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
        if (simhash.fingerprint(rows[-1][1], 5) ^ simhash.fingerprint(rows[-2][1], 5)).bit_count() <= simhash.MAX_DISTANCE:
            close.add(2 * k + 1)
    monkeypatch.setattr(near, "groups", lambda distinct, size: near.fingerprint_groups(distinct, size).limit(0))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for size in (4096, 1):  # whole classes, and classes taken as hot
        got = {x.doc_id: x.component_id for x in near.near_documents(docs, size=size).collect()}
        assert close and got == {d: d - 1 if d in close else d for d, _ in rows}


def test_empty(spark):
    assert near.near_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
