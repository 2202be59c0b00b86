"""Packing: ids against the tokenizers library, plans that hold what they must, and gapless sequences."""

import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from logfold.llm import packing, tokens

PATH = packing.default_vocabulary()


def test_ids_equal_the_library():
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    r = random.Random(3)
    signs = "aé \n\t0９Ω漢's'LL'll　\u0085\x1c\x1f-😀ǅⅣ²bc"
    for text in ["", "<|endoftext|>", "a <|endoftext|>b", *("".join(r.choice(signs) for _ in range(r.randint(0, 14))) for _ in range(3000))]:
        assert np.frombuffer(tokens.encode(text, PATH), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(4))
def test_plan_holds_the_histogram(seed):
    r = random.Random(seed)
    h = {}
    for _ in range(r.choice([1, 30, 3000])):
        n = min(256, int(r.expovariate(1 / 60)) + 1)
        h[n] = h.get(n, 0) + r.choice([1, 1, 9])
    plan = packing.solve(h, 256)
    got = {}
    for p, times in plan:
        assert times > 0 and sum(n * c for n, c in p) <= 256
        for n, c in p:
            got[n] = got.get(n, 0) + c * times
    assert got == h
    assert sum(t for _, t in plan) <= sum(t for _, t in packing.best_fit(h, 256))


@pytest.mark.parametrize("kind", ["uniform", "exponential", "triple", "wide"])
def test_plan_meets_the_dual_bound(kind):
    r = random.Random(1)
    draw = {"uniform": lambda: r.randint(1, 1023), "exponential": lambda: min(1023, int(r.expovariate(1 / 150)) + 1), "triple": lambda: r.choice([550, 450, 250, 150]), "wide": lambda: r.choice([550, 515])}[kind]
    h = {}
    for _ in range(6000):
        n = draw()
        h[n] = h.get(n, 0) + 1
    sizes = np.array(sorted(h))
    need = np.array([h[int(n)] for n in sizes], float)
    mix = packing.fractional(sizes, need, 1024, packing.fill(h, 1024))
    lacks = np.maximum(need - mix.covered(), 0)
    used = mix.weight.sum() + (lacks / (1024 // sizes)).sum()
    assert mix.bound <= used * (1 + 1e-6) and used <= 1.01 * mix.bound + 1
    placed, rest = packing._rounded(mix, need)
    assert sum(n * c for n, c in rest.items()) < 0.1 * (need * sizes).sum()
    total = sum(t for _, t in packing.solve(h, 1024))
    assert np.ceil(mix.bound - 1e-6) <= total <= sum(t for _, t in packing.best_fit(h, 1024)) and total <= 1.01 * mix.bound + 1


def test_packing_covers_every_token(spark):
    rows = [(k, "word " * n, "x") for k, n in enumerate([0, 1, 5, 40, 200, 900, 3, 3, 3])] + [(99, None, "y"), (7, "word word word", "z"), (7, "word word word", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string")
    full = packing.pack_documents(docs, capacity=64, keep_ids=True)
    out = full.toPandas()
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    expected = sorted(zlib.crc32(np.array(ids[a : a + n], "<u4").tobytes()) for _, text, _ in rows for ids in [t.encode(text or "", add_special_tokens=False).ids + [0]] for a, n in packing._cuts(len(ids), 64))
    assert sorted(out.ids_crc32) == expected
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= 64
    whole = packing.sequences(full).toPandas()
    assert len(whole) == out.sequence_id.nunique() and sum(map(len, whole.ids)) == 4 * out.length.sum()


def test_empty_table(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
