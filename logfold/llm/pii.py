"""Personal data (5): base patterns, and an offset-preserving deobfuscation of disguised identifiers.

Base spans come from the four fixed patterns, leftmost and non-overlapping per kind, each found where it can begin: an
email at its @, the rest at digits or a plus sign, so that scanning a text is linear in its length.

Disguised identifiers are found by a chain of small transducers. Each rewrites the text left to right and carries, for
every character it emits, where the source characters begin and end: homoglyphs (full-width and other compatibility forms,
Cyrillic, Greek and Armenian look-alikes, digits of any script) become ASCII, runs of spelled digits (with double and triple)
become digits, also as the parts of an address with its dots written out, and the disguises of @ and of the dot become
those signs: after an @, however written, any last label of letters ends a domain,
but a bare "at ... dot ..." that reads as prose ("look at the dot on") needs a last label of a fixed list. The base patterns are then run on the rewritten text and their spans
mapped back. Found spans that meet a base span of their kind are not added. A rewritten match counts only if one of its
characters was rewritten.

Null texts are empty. Offsets are code points, ends exclusive. Long texts are read whole; repeated rows are each
returned; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from logfold.llm.common import arrow_map, table, texts

KINDS = ("email", "ip", "card", "phone")

# Fixed patterns of the contract, anchored where a match can begin.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+@")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LONG = re.compile(r"[0-9](?:[\x20-]?[0-9]){13}")


def _emails(text: str) -> list[tuple[int, int]]:
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and not _NOT_LOCAL.match(text, start - 1):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found.append((start, m.end()))
            free = m.end()
        else:
            free = max(free, at + 1)  # no local part reaches over an @
        at = text.find("@", free)
    return found


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """start, end, kind of every base match, by start and kind as listed."""
    found = [(a, b, "email") for a, b in _emails(text)] if "@" in text else []
    if "." in text:
        found += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
    if _LONG.search(text):
        found += [(m.start(), m.end(), "card") for m in _CARD.finditer(text) if 14 <= len(d := _digits(m[0])) <= 19 and _luhn(d)]
    if "+" in text:
        found += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


# Fixed look-alikes: Cyrillic and Greek letters drawn like Latin ones, and signs drawn like @, dot, plus and hyphen.
_ALIKE = dict(zip("аВсеЕНіјКМорРТхуѕАСОХΑΒΕΗΙΚΜΝΟΡΤΥΖαορνι", "aBceEHijKMopPTxysACOXABEHIKMNOPTYZaopvi")) | dict(zip("ԁԛԝһӏɡօսոқ", "dqwhlgounk")) | dict(zip("。．․﹒‧∙＠﹫＋﹢‐‑‒–—−﹣－", "......@@++--------"[:18]))
_SPELLED = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
_WORD = "|".join(_SPELLED)
_TIMES = {"double": 2, "triple": 3}
_UNIT = rf"(?:(?:double|triple) )?(?:{_WORD}|[0-9])"
_SPELLED_RUN = re.compile(rf"\b{_UNIT}(?:[ ,.-]{{0,2}}{_UNIT})+\b", re.I)
_ONE = re.compile(rf"(?:(double|triple) )?({_WORD}|[0-9])", re.I)
#: Four parts of an address with their dots written out, the parts in figures or in spelled digits.
_OCTET = rf"(?:[0-9]{{1,3}}|{_UNIT}(?:[ -]{_UNIT}){{0,2}})"
_IP_DOTS = re.compile(rf"(?<![\w.]){_OCTET}(?:\s+(?:dot|point)\s+{_OCTET}){{3}}(?![\w.]*[0-9])", re.I)
_IP_PART = re.compile(rf"(?P<dot>\s+(?:dot|point)\s+)|{_ONE.pattern}", re.I)
#: An address with its signs as words between underscores or hyphens.
_KNOTTED = re.compile(r"(?<![\w.%+-])[A-Za-z0-9._%+-]*?[A-Za-z0-9]([_-])at\1[A-Za-z0-9]+(?:-[A-Za-z0-9]+)*?(?:\1dot\1[A-Za-z0-9]+)*\1dot\1[A-Za-z]{2,24}(?![\w-])", re.I)
_KNOT = re.compile(r"([_-])(at|dot)\1", re.I)
_PLUS = re.compile(r"\bplus (?=[0-9])", re.I)
#: Last labels of a domain that count in any frame; where no at or dot frame is sure, only these count.
_ENDS = "com|org|net|edu|gov|info|io|co|uk|de|fr|es|eu|example|test"
_END = re.compile(rf"(?:{_ENDS})\b", re.I)
#: Words that make "at ... dot ..." read as prose: before the at, before the dot, and after it (country codes left out).
_VERBS = re.compile(r"\b(?:look|star|point|gaz|glanc|aim|arriv|laugh|shout|smil|peer|peek|squint|swip|work|liv)(?:e|s|es|ed|d|ing)?$", re.I)
_NOT_LABELS = frozenset("a an the this that these those each every any some one no its his her my our your their first last next second third single red green blue black white yellow big small tiny little polka quantum laser micro".split())
_NOT_ENDS = frozenset("on of and or but is was were are the this that which with for from an if when where while then than there above below under over near before after into onto matrix product products pattern patterns plot plots size sizes".split())
_AT = re.compile(rf"(?<!\s)\s*(?:\[\s*(?:at|@)\s*\]|\(\s*(?:at|@)\s*\)|\{{\s*(?:at|@)\s*\}}|<\s*(?:at|@)\s*>|\bat(?=\s+[A-Za-z0-9-]+\s*[\[({{<]\s*dot\s*[\])}}>])|(?:\bat|(?<=\s)@)(?=\s+(?:[A-Za-z0-9-]+\s+dot\s+){{1,6}}[A-Za-z]{{2}}))\s*", re.I)
_BARE = re.compile(r"((?:[A-Za-z0-9-]+\s+dot\s+){1,6})([A-Za-z]{2,24})(?![A-Za-z0-9])", re.I)
_BARE_LISTED = re.compile(rf"(?:[A-Za-z0-9-]+\s+dot\s+){{1,6}}(?:{_ENDS})\b", re.I)
#: A domain after an @ with dots written out, and those dots: any last label of letters counts there.
_FRAMED = re.compile(r"@[A-Za-z0-9.-]+(?:(?:\s+dot\s+|\s*[\[({<]\s*(?:dot|\.)\s*[\])}>]\s*)[A-Za-z0-9-]+)+", re.I)
_FRAMED_DOT = re.compile(r"\s*([\[({<]?)\s*(?:\bdot\b|(?<=[\[({<\s])\.)\s*[\])}>]?\s*(?=([A-Za-z0-9-]+))", re.I)
_DOT = re.compile(rf"(?<!\s)\s*(?:\[\s*(?:dot|\.)\s*\]|\(\s*(?:dot|\.)\s*\)|\{{\s*(?:dot|\.)\s*\}}|<\s*(?:dot|\.)\s*>|\bdot(?=\s+(?:[A-Za-z0-9-]+\s+dot\s+){{0,6}}(?:{_ENDS})\b))\s*", re.I)
_AROUND_AT = re.compile(r"(?<!\s)\s+@\s+(?=[A-Za-z0-9-]+\s*\.)|(?<!\s)\s+@(?=[A-Za-z0-9-]+\.)")
_LOOK_SET = frozenset(_ALIKE) | {chr(k) for a, b in (("！", "～"), ("\U0001d400", "\U0001d7ff"), ("①", "⑳")) for k in range(ord(a), ord(b) + 1)} | {chr(k) for k in range(0x80, 0x110000) if unicodedata.category(chr(k)) == "Nd"}
_LOOKS = re.compile(f"[{re.escape(''.join(sorted(_LOOK_SET)))}]")
#: What else the transducers can rewrite, by a text in small letters that goes with each and a pattern for it.
_HINTS = [
    ((" @", "\t@", "\n@"), None),
    (("@",), re.compile(r"\s@")),
    (("dot", "point"), re.compile(r"\b(?:dot|point)\b")),
    (("[", "(", "{", "<"), re.compile(r"[\[({<]\s*(?:at|dot|@|\.)\s*[\])}>]")),
    (("_at_", "-at-"), None),
    (("double ", "triple "), re.compile(rf"\b(?:double|triple) (?:{_WORD}|[0-9])")),
    (("plus ",), re.compile(r"\bplus [0-9]")),
    (tuple(_SPELLED), re.compile(rf"(?:{_WORD})[ ,.-]{{0,2}}(?:{_WORD}|[0-9])")),
    (tuple(_SPELLED), re.compile(rf"[0-9][ ,.-]{{0,2}}(?:{_WORD})")),
]


def may_hide(text: str) -> bool:
    """False only if no transducer can rewrite anything in the text. Letters with accents are not look-alikes."""
    if not text.isascii() and not _LOOK_SET.isdisjoint(text):
        return True
    low = text.lower() if text.isascii() else text.casefold()
    return any(any(w in low for w in words) and (pattern is None or pattern.search(low)) for words, pattern in _HINTS)


_Tape = tuple[str, list[int], list[int], list[bool]]


def _rewrite(tape: _Tape, pattern: re.Pattern, by) -> _Tape:
    """One transducer: matches are replaced by what by() gives; each new character spans its whole source match, unless
    by() gives a list of characters with their places in the match."""
    text, begin, end, changed = tape
    out: list[str] = []
    b: list[int] = []
    e: list[int] = []
    c: list[bool] = []
    last = 0
    for m in pattern.finditer(text):
        new = by(m)
        if new is None:
            continue
        s = m.start()
        out.append(text[last:s])
        b += begin[last:s]
        e += end[last:s]
        c += changed[last:s]
        for char, i, j in new:
            out.append(char)
            b.append(begin[i])
            e.append(end[j - 1])
            c.append(True)
        last = m.end()
    if not out:
        return tape
    return "".join([*out, text[last:]]), b + begin[last:], e + end[last:], c + changed[last:]


def _alike(m: re.Match) -> list[tuple[str, int, int]] | None:
    char = m[0]
    plain = _ALIKE.get(char) or unicodedata.normalize("NFKC", char)
    if not plain.isascii() and unicodedata.digit(char, None) is not None:
        plain = str(unicodedata.digit(char))
    return [(x, m.start(), m.end()) for x in plain] if plain.isascii() and plain != char else None


def _spelled(m: re.Match) -> list[tuple[str, int, int]] | None:
    parts = list(_ONE.finditer(m.string, m.start(), m.end()))
    out = [(_SPELLED.get(p[2].lower(), p[2]), p.start(), p.end()) for p in parts for _ in range(_TIMES.get((p[1] or "").lower(), 1))]
    return out if len(out) >= 7 and any(p[1] or not p[2].isdigit() for p in parts) else None


def _dotted(m: re.Match) -> list[tuple[str, int, int]]:
    out = []
    for p in _IP_PART.finditer(m.string, m.start(), m.end()):
        if p["dot"]:
            out.append((".", p.start(), p.end()))
        else:
            out += [(_SPELLED.get(p[3].lower(), p[3]), p.start(), p.end())] * _TIMES.get((p[2] or "").lower(), 1)
    return out


def _knotted(m: re.Match) -> list[tuple[str, int, int]]:
    out, last, seen = [], m.start(), False
    for k in _KNOT.finditer(m.string, m.start(), m.end()):
        if (k[2].lower() == "at") == seen:  # one at, then dots
            continue
        seen = True
        out += [(m.string[i], i, i + 1) for i in range(last, k.start())]
        out.append(("@" if k[2].lower() == "at" else ".", k.start(), k.end()))
        last = k.end()
    return out + [(m.string[i], i, i + 1) for i in range(last, m.end())]


def _sign(sign: str):
    def by(m: re.Match) -> list[tuple[str, int, int]]:
        core = m[0].strip()
        start = m.start() + m[0].index(core)
        return [(sign, start, start + len(core))]

    return by


def _at(m: re.Match) -> list[tuple[str, int, int]] | None:
    """The sign, unless a bare at reads as prose and no listed label ends its domain."""
    if m[0].strip().lower() in ("at", "@") and (frame := _BARE.match(m.string, m.end())) and not _BARE_LISTED.match(m.string, m.end()):
        labels = frame[1].lower().split()
        if frame[2].lower() in _NOT_ENDS or labels[0] in _NOT_LABELS or _VERBS.search(m.string[max(0, m.start() - 24) : m.start()]):
            return None
    return _sign("@")(m)


def _framed(m: re.Match) -> list[tuple[str, int, int]] | None:
    """The domain with its written-out dots as signs, up to the last label that can end one."""
    dots = list(_FRAMED_DOT.finditer(m.string, m.start() + 1, m.end()))
    while dots:
        end = dots[-1][2]
        if dots[-1][1] or _END.fullmatch(end) or re.fullmatch(r"[A-Za-z]{2,24}", end) and end.lower() not in _NOT_ENDS:
            break
        dots.pop()
    if not dots:
        return None
    out, last = [], m.start()
    for d in dots:
        out += [(m.string[k], k, k + 1) for k in range(last, d.start())]
        out += _sign(".")(d)
        last = d.end()
    return out + [(m.string[k], k, k + 1) for k in range(last, m.end())]


def normalise(text: str) -> _Tape:
    """The rewritten text with, per character, where its source begins and ends and whether it was rewritten."""
    n = len(text)
    tape: _Tape = (text, list(range(n)), list(range(1, n + 1)), [False] * n)
    tape = _rewrite(tape, _LOOKS, _alike)
    tape = _rewrite(tape, _KNOTTED, _knotted)
    tape = _rewrite(tape, _IP_DOTS, _dotted)
    tape = _rewrite(tape, _AT, _at)
    tape = _rewrite(tape, _AROUND_AT, _sign("@"))
    tape = _rewrite(tape, _FRAMED, _framed)
    tape = _rewrite(tape, _DOT, _sign("."))
    tape = _rewrite(tape, _SPELLED_RUN, _spelled)
    return _rewrite(tape, _PLUS, _sign("+"))


def hidden_spans(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Spans of disguised identifiers that no base span of their kind meets."""
    if not may_hide(text):
        return []
    plain, begin, end, changed = normalise(text)
    if not any(changed):
        return []
    found = []
    for a, b, kind in base_spans(plain):
        if any(changed[a:b]):
            s, e = begin[a], end[b - 1]
            if not any(k == kind and s < y and x < e for x, y, k in base):
                found.append((s, e, kind))
    return found


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]), x[1])))


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with every span, or run of overlapping spans, replaced by the first one's kind in angle brackets."""
    out, last = [], 0
    for a, b, kind in sorted(spans):
        if a >= last:
            out += [text[last:a], f"<{kind.upper()}>"]
        last = max(last, b)
    return "".join([*out, text[last:]])


def find(docs: DataFrame) -> DataFrame:
    """doc_id, redacted text, counts of base spans by kind, base_sha256, spans, and n_hidden, the spans the method added."""

    def run(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [] for k in ("redacted", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_hidden")}
        for text in batch.column("text").to_pylist():
            text = text or ""
            base = base_spans(text)
            hidden = hidden_spans(text, base)
            for k in KINDS:
                out[f"n_{k}"].append(sum(x[2] == k for x in base))
            out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
            out["spans"].append(joined(base + hidden))
            out["n_hidden"].append(len(hidden))
            out["redacted"].append(redact(text, base + hidden))
        return out | {"doc_id": batch.column("doc_id")}

    return arrow_map(texts(docs), run, "doc_id long, redacted string, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_hidden long")


def redact_documents(docs: DataFrame) -> DataFrame:
    """docs with the personal data of its text replaced, all other columns as they are; null texts stay null."""
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                new = []
                for text in batch.column(at).to_pylist():
                    base = base_spans(text) if text else []
                    new.append(text and redact(text, base + hidden_spans(text, base)))
                yield batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))

    from logfold.llm.common import prepare

    prepare(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents")).drop("redacted")
