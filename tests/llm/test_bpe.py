"""BPE: both forms against the library, and exact round trips."""

import hashlib
import random

import pytest
import tiktoken
import public_tokenizers as P

from logfold.llm import bpe, tokens


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=tokens.ranks(bpe.default_vocabulary()), special_tokens={})


def sample():
    r = random.Random(7)
    signs = "aé \n\t0９Ω漢's'LL'll　\u0085\xa0\x1c-😀²bcth"
    rows = [(k, "".join(r.choice(signs) for _ in range(r.randint(0, 30)))) for k in range(200)]
    rows += [(300, None), (301, ""), (302, "<|endoftext|> x"), (303, "Thereafter, internationalisation's ouèle übergrößen."), (304, "a" * 300), (304, "a" * 300), (None, "hello world  \n\n x ")]
    return rows


def test_forms_equal_the_library(spark, library):
    rows = sample()
    docs = spark.createDataFrame([(t, d, "w") for d, t in rows], "text string, doc_id long, words string")
    want = sorted(((d, library.encode_ordinary(t or "")) for d, t in rows), key=str)
    for form in (bpe.encode, bpe.encode_native):
        assert sorted(((r.doc_id, list(r.ids)) for r in form(docs).collect()), key=str) == want
    texts = sorted(((d, (t or "").encode()) for d, t in rows), key=str)
    assert sorted(((r.doc_id, bytes(r.decoded)) for r in bpe.decode(bpe.encode(docs)).collect()), key=str) == texts
    assert sorted(((r.doc_id, bytes(r.decoded)) for r in bpe.decode_native(bpe.encode(docs)).collect()), key=str) == texts
    ids = {r.ids_sha256 for r in bpe.decode(bpe.encode(docs)).collect()}
    assert ids == {hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for _, x in want}


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.decode(bpe.encode(empty)).count() == 0 and bpe.encode_native(empty).count() == 0
