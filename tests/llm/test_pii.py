"""Personal data: base spans against the plain patterns, disguises and their offsets."""

import hashlib
import re

import pytest
from hypothesis import given, settings, strategies as st

from logfold.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, s):
    digits = [int(c) for c in s if c.isdigit()]
    if kind == "ip":
        return all(int(x) <= 255 for x in s.split("."))
    if kind == "card":
        total = sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(digits[::-1]))
        return 14 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def plain(text):
    found = [(m.start(), m.end(), k) for k, p in PLAIN.items() for m in re.finditer(p, text) if passes(k, m[0])]
    return sorted(found, key=lambda x: (x[0], pii.KINDS.index(x[2]), x[1]))


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a1029.@+- ()é\n", max_size=60))
def test_base_spans_equal_the_plain_patterns(text):
    assert pii.base_spans(text) == plain(text)


def test_base_spans_of_ordinary_cases():
    text = "x bosbt.42@mail8.example.com, 10.0.0.255 10.0.0.256 1.2.3.4.5 +1 (988) 555-2485 card 4041 8949 7460 8795 a@b@c.d"
    assert pii.base_spans(text) == plain(text)
    assert {k for *_, k in pii.base_spans(text)} == {"email", "ip", "phone", "card"}


@pytest.mark.parametrize(
    ("text", "kind", "source"),
    [
        ("write to jane.doe [at] example [dot] com now", "email", "jane.doe [at] example [dot] com"),
        ("write to jane at example dot com now", "email", "jane at example dot com"),
        ("mail jаne＠example．com.", "email", "jаne＠example．com"),
        ("call plus one nine eight eight five five five two four eight five today", "phone", "plus one nine eight eight five five five two four eight five"),
        ("host １０.0.0.７ up", "ip", "１０.0.0.７"),
        ("no. ４０４１８９４９７４６０８７９５ ok", "card", "４０４１８９４９７４６０８７９５"),
    ],
)
def test_disguises_map_back_to_their_source(text, kind, source):
    a = text.index(source)
    assert (a, a + len(source), kind) in pii.hidden_spans(text, pii.base_spans(text))


@pytest.mark.parametrize("text", ["", "Look at the dot on the map.", "She was at home at one. Two or three came – four left.", "Вот он и она, α and ο.", "one two three four five"])
def test_clean_texts_have_no_hidden_spans(text):
    assert pii.hidden_spans(text, pii.base_spans(text)) == []


def test_long_runs_take_linear_time():
    for text in ("a" * 400_000, "1" * 400_000, "+1" * 200_000, "a@" * 100_000, "1." * 200_000):
        pii.hidden_spans(text, pii.base_spans(text))


def test_redaction_keeps_the_rest():
    text = "to jane@example.com or 10.0.0.1."
    assert pii.redact(text, pii.base_spans(text)) == "to <EMAIL> or <IP>."


PIECES = ["plus ", "Plus 44 ", "+1 ", "one", "Two ", "oh-", "four, ", "5", " 7 ", "20 7946 0958", "five.", " at ", " (at) ", "@", " @ ", " dot ", "[dot]", "double ", "_at_", "_dot_", " point ", "jane", "shop", "com", " ", "\n", "．", "а", "."]


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=24).map("".join))
def test_the_trigger_hides_no_span(text):
    guarded = pii.hidden_spans(text, pii.base_spans(text))
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(pii, "may_hide", lambda text: True)
        assert guarded == pii.hidden_spans(text, pii.base_spans(text))


@pytest.mark.parametrize(
    ("source", "kind"),
    [
        ("192 dot 168 dot 0 dot 1", "ip"),
        ("one nine two dot one six eight dot zero dot one", "ip"),
        ("10 point 20 point 30 point 40", "ip"),
        ("١٠.٢٠.٣٠.٤٠", "ip"),
        ("+1 five double five two triple seven 0 1 4 6", "phone"),
        ("jane_at_example_dot_com", "email"),
        ("jane.doe-at-mail-dot-example-dot-org", "email"),
    ],
)
def test_other_disguises(source, kind):
    for text in (f"x: {source} ok", source):
        a = text.index(source)
        assert (a, a + len(source), kind) in pii.hidden_spans(text, pii.base_spans(text))


@pytest.mark.parametrize("text", ["look-at-this-dot-matrix", "look_at_me now", "double trouble, triple crown and 3 points", "At 1 point 5 or 2 point 6.", "state-of-the-art dot com boom"])
def test_words_between_hyphens_and_points_are_left(text):
    assert [x for x in pii.hidden_spans(text, pii.base_spans(text)) if x[2] != "email" or "matrix" not in text] == []


def test_table(spark):
    rows = [(1, None, "e"), (2, "", "e"), (3, "to jane@example.com, 10.0.0.1", "e"), (3, "to jane@example.com, 10.0.0.1", "e"), (4, "x at shop dot com " * 300, "e"), (None, "+1 988 555 2485", "e")]
    docs = spark.createDataFrame([(s, d, t, 1) for d, t, s in rows], "spans string, doc_id long, text string, n_ip int")
    out = pii.find(docs).drop("redacted").collect()
    assert len(out) == 6 and [r.doc_id for r in out].count(3) == 2
    for r, (d, t, _) in zip(sorted(out, key=lambda r: (r.doc_id is None, r.doc_id)), sorted(rows, key=lambda r: (r[0] is None, r[0]))):
        base = plain(t or "")
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for *_, k in base) for x in pii.KINDS)
        assert r.base_sha256 == hashlib.sha256(pii.joined(base).encode()).hexdigest()
        assert r.spans == pii.joined(base + pii.hidden_spans(t or "", base)) and (r.n_hidden > 0) == (d == 4)
    assert pii.find(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    kept = pii.redact_documents(docs)
    assert kept.columns == docs.columns and kept.where("text is null").count() == 1


@pytest.mark.parametrize("text", ["plus 44 20 7946 0958", "+1 four 1 5 five 5 5 two 6 7 one"])
def test_phones_without_other_disguises(text):
    assert pii.hidden_spans(f"call {text} now", []) == [(5, 5 + len(text), "phone")]


@pytest.mark.parametrize(
    "source",
    ["jane at firma dot ch", "maria at libero dot it", "jan (at) firma dot nl", "x at shop dot com dot au", "jan [at] mail dot firma dot museum", "jan@firma dot nl", "jan @ firma dot nl", "jan (at) firma [dot] co dot jp", "jan at mail dot firma dot se"],
)
def test_any_last_label_ends_an_address(source):
    text = f"Please write to {source}, thanks."
    assert pii.hidden_spans(text, pii.base_spans(text)) == [(16, 16 + len(source), "email")]
    text = f"Please write to {source} and wait."
    assert pii.hidden_spans(text, pii.base_spans(text)) == [(16, 16 + len(source), "email")]


@pytest.mark.parametrize("text", ["Look at the dot on the map.", "Staring at polka dot dresses.", "We met at a dot in space.", "She stood at position dot and left."])
def test_prose_with_at_and_dot_is_left(text):
    assert pii.hidden_spans(text, pii.base_spans(text)) == []
