"""Line dedup against a brute-force version."""

import random

import numpy as np

from logfold.llm import lines


def shingles(x):
    return {x[k : k + 8] for k in range(max(1, len(x) - 7))}


def brute(rows):
    """doc_id, new text by exhaustive comparison; rows sorted as the operator orders first lines."""
    first, sets = {}, {}
    for doc, text in sorted(((d, t) for d, t in rows if t), key=lambda r: r[0]):
        for k, line in enumerate(text.split("\n")):
            if line.strip():
                first.setdefault(line.strip(), (doc, k))
    keys = list(first)
    sets = [shingles(k) for k in keys]
    root = list(range(len(keys)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(keys)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if min(len(a), len(b)) >= 0.8 * max(len(a), len(b)):
                n = len(a & b)
                if n >= 0.8 * (len(a) + len(b) - n):
                    root[max(find(i), find(j))] = min(find(i), find(j))
    best = {}
    for k, key in enumerate(keys):
        r = find(k)
        if r not in best or first[key] < first[best[r]]:
            best[r] = key
    stay = {first[key] for key in best.values()}
    out = []
    for doc, text in rows:
        if text:
            left = [x for k, x in enumerate(text.split("\n")) if not x.strip() or (doc, k) in stay]
            if len(left) < len(text.split("\n")):
                text = "\n".join(left) if any(x.strip() for x in left) else ""
        out.append((doc, text))
    return sorted(out, key=lambda r: (r[0], r[1] or ""))


def run(spark, rows, **more):
    docs = spark.createDataFrame([(t, d, "k", 1) for d, t in rows], "text string, doc_id long, key string, line int")
    out = lines.dedup(docs, **more)
    assert out.columns == ["text", "doc_id", "key", "line", "n_lines_removed"]
    return sorted(((r.doc_id, r.text) for r in out.collect()), key=lambda r: (r[0], r[1] or ""))


def test_equals_brute_force(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7)))
    stock = [" ".join(word() for _ in range(r.randint(1, 30))) for _ in range(40)]

    def vary(line):
        parts = line.split(" ")
        for _ in range(r.choice([0, 0, 1, 1, 2])):
            parts[r.randrange(len(parts))] = word()
        return " ".join(parts)

    rows = [(d, "\n".join(r.choice(["", " "]) if r.random() < 0.1 else vary(r.choice(stock)) for _ in range(r.randint(0, 9)))) for d in range(150)]
    rows += [(500, None), (501, ""), (502, "\n \n"), (503, "ab\nab\ncd"), (504, "x" * 50_000), (505, "y" + "x" * 50_000)]
    assert run(spark, rows) == brute(rows)


def test_hot_bucket_by_pivots(spark, monkeypatch):
    base = " ".join(f"word{k}" for k in range(60))
    rows = [(d, base.replace(f"word{d} ", f"other{d} ")) for d in range(50)]
    rows += [(100 + d, " ".join(f"word{k}" for k in range(d, 40 + d))) for d in range(40)]  # a chain: far ends don't link
    assert run(spark, rows, group=8, pivots=3) == brute(rows)
    monkeypatch.setattr(lines, "HELD_BYTES", 256)  # hot rows go out before the run is read
    assert run(spark, rows, group=8, pivots=3) == brute(rows)


def test_hot_bucket_of_lines_apart_takes_two_passes(spark, monkeypatch):
    """Most lines of a hot bucket have no link; the passes over it don't grow with their number."""
    r = random.Random(4)
    base = [f"word{k}" for k in range(40)]
    texts = [" ".join(base[:k] + ["new"] + base[k + 1 :]) for k in range(20)]
    texts += [" ".join(x if r.random() < 0.5 else f"w{r.randrange(10**6)}" for x in base) for _ in range(100)]
    texts += [x + " end" for x in texts[20::7]]
    hot = spark.createDataFrame([(b"b", k) for k in range(len(texts))], "grp binary, line long")
    found = spark.createDataFrame(list(enumerate(texts)), "line long, text string")
    rounds = []
    monkeypatch.setattr(lines, "components", lambda e, f=lines.components: rounds.append(1) or f(e))
    edges = lines.stored(spark.createDataFrame([], "a long, b long"), "edges")
    edges = lines.hot_links(hot, found, edges, lines._sets, 0.8, 12, 2)
    assert len(rounds) <= 2
    got = {x.node: x.component for x in lines.components(edges).collect()}
    sets, want = [shingles(x) for x in texts], {}
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                want.setdefault(i, set()).add(j)
    assert want and all(got[i] == got[j] for i, near in want.items() for j in near)
    assert len(set(got.values())) == 1 + len(texts[20:120:7]) and len(got) == 20 + 2 * len(texts[20:120:7])


def test_the_index_of_a_group_loses_no_link():
    r = random.Random(2)
    for similarity in (0.5, 0.8, 0.9) * 10:
        base = ["".join(r.choice("abcd ") for _ in range(r.choice([5, 40, 120]))) for _ in range(3)]
        some = []
        for _ in range(40):
            x = list(r.choice(base))
            for _ in range(r.randint(0, 5)):
                x[r.randrange(len(x))] = r.choice("abcdefgh")
            some.append("".join(x))
        sets = lines._sets(some)
        found = []
        for edges in (lines._linked(sets, similarity), lines._linked_one_by_one(sets, np.array([len(x) for x in sets]), similarity)):
            root = list(range(len(some)))
            for i, j in edges:
                root = [root[i] if x == root[j] else x for x in root]
            found.append({frozenset(k for k in range(len(some)) if root[k] == x) for x in root})
        assert found[0] == found[1]


def test_a_group_near_the_threshold_is_met_without_its_shingles(monkeypatch):
    """Of lines that miss a link by little, only the rarest shingles are looked up and no set is gone through."""
    r = random.Random(8)
    base = [f"word{k}" for k in range(60)]
    some = [" ".join(x if r.random() < 0.93 else r.choice(("one", "two", "three", "four")) for x in base) for _ in range(300)]
    sets, looked = lines._sets(some), []
    monkeypatch.setattr(lines, "_ranges", lambda a, b, f=lines._ranges: looked.append(int(b.sum())) or f(a, b))
    got = []
    for words in (lines.BIT_WORDS, 0):
        monkeypatch.setattr(lines, "BIT_WORDS", words)
        root = list(range(len(some)))
        for i, j in lines._linked(sets, 0.8):
            root = [root[i] if x == root[j] else x for x in root]
        got.append({frozenset(k for k in range(len(some)) if root[k] == x) for x in root})
        if words:
            assert sum(looked) < 2_000_000
    assert got[0] == got[1] and 1 < len(got[0]) < len(some)


def test_stars_equal_sets():
    r = random.Random(9)
    parts = [["".join(r.choice("abc") for _ in range(r.randint(1, 60))) for _ in range(r.randint(1, 5))] for _ in range(40)]
    begins = [sum(map(len, parts[:k])) for k in range(len(parts))]
    got = lines._star([x for p in parts for x in p], np.array(begins))
    want = [len(shingles(p[0].strip()) & shingles(x.strip())) / len(shingles(p[0].strip()) | shingles(x.strip())) for p in parts for x in p]
    assert np.allclose(got, want)


def test_rows_without_ids_take_no_longer(spark):
    """Rows that share an id are joined by their texts' hashes, so each row meets its own lines only."""
    rows = [(None, f"line {d} of many\nshared line of text here") for d in range(400)] + [(7, f"row {d}") for d in range(50)] + [(7, "row 1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = lines.dedup(docs).collect()
    assert len(out) == len(rows)
    assert sum("shared line" in r.text for r in out) == 1
    assert sum(r.text == "row 1" for r in out if r.doc_id == 7) == 2  # copies keep their lines together


def test_empty_table(spark):
    assert run(spark, []) == []


def test_bands_find_near_lines():
    r = random.Random(1)
    found = 0
    for _ in range(300):
        a = "".join(r.choice("abcdefghij ") for _ in range(300))
        b = list(a)
        while True:
            c = list(b)
            c[r.randrange(300)] = "#"
            x, y = shingles(a), shingles("".join(c))
            if len(x & y) < 0.8 * len(x | y):
                break
            b = c
        u = lines.bands([a, "".join(b)])
        found += bool((u[:, 0] == u[:, 1]).any())
    assert found >= 297
