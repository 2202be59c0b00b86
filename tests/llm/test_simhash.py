"""SimHash against a brute-force version."""

import random

import numpy as np
import xxhash

from logfold.llm import components, simhash


def plain(text, n=4):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[k : k + n]) for k in range(max(1, len(words) - n + 1))]
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(prints, distance=4):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(k) for k in range(len(prints))]


def test_fingerprints():
    r = random.Random(2)
    for _ in range(300):
        text = "".join(r.choice("aBÀé \n\t\x0b\x1c\xa0") for _ in range(r.randint(0, 60)))
        assert simhash.fingerprint(text) == plain(text)
    assert simhash.fingerprint(None) == 0


def test_near_duplicates(spark):
    r = random.Random(4)
    base = [[f"w{r.randrange(500)}" for _ in range(120)] for _ in range(25)]
    texts = [None, "", " \n"]
    for k in range(250):
        words = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2, 9])):
            words[r.randrange(len(words))] = f"x{k}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame([(f"{k}", t, 1000 - k) for k, t in enumerate(texts)], "fp string, text string, doc_id long")
    out = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    prints = [plain(t) for t in texts]
    root = brute(prints)
    least = {}
    for k, x in enumerate(root):
        least[x] = min(least.get(x, 10**9), 1000 - k)
    assert {d: (x.fingerprint, x.component_id) for d, x in out.items()} == {1000 - k: (f"{prints[k]:016x}", least[root[k]]) for k in range(len(texts))}


def test_large_cells_are_cut_exactly(monkeypatch):
    monkeypatch.setattr(simhash, "CELL_ROWS", 10)
    r = np.random.default_rng(1)
    centre = r.integers(0, 2**63, 6, dtype=np.uint64)
    fps = np.unique([c ^ np.bitwise_or.reduce(np.uint64(1) << r.integers(0, 64, 3, dtype=np.uint64)) for c in centre for _ in range(40)])
    edges = simhash._links(fps, 4)
    same = {int(x): int(x) for x in fps}

    def find(x):
        while same[x] != x:
            x = same[x]
        return x

    for a, b in edges.tolist():
        assert (a ^ b).bit_count() <= 4
        same[find(a)] = find(b)
    got = [find(int(x)) for x in fps]
    want = brute([int(x) for x in fps])
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_components_of_a_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(5, 5), (7, 6), (6, 7)]
    out = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 160)}


def test_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
