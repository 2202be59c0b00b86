"""SQLite's text: tokens, statements, and the way to the translator."""

from __future__ import annotations

import re
from dataclasses import dataclass

_TOKEN = re.compile(
    r"""(?P<space>\s+|--[^\n]*|/\*.*?(?:\*/|\Z))|(?P<blob>[xX]'[0-9A-Fa-f]*')|(?P<text>'(?:[^']|'')*')|(?P<name>"(?:[^"]|"")*"|`[^`]*`|\[[^\]]*\]|[A-Za-z_]\w*)"""
    r"""|(?P<number>\d+\.\d*(?:[eE][-+]?\d+)?|\.\d+(?:[eE][-+]?\d+)?|\d+[eE][-+]?\d+|\d+)|(?P<sign>->>|->|\|\||<=|>=|<>|!=|==|<<|>>|[-+*/%<>=~&|(),.;?:])|(?P<other>.)""",
    re.S,
)


@dataclass
class Token:
    kind: str
    text: str

    @property
    def word(self) -> str:
        return self.text.upper() if self.kind == "name" else self.text


def tokens(sql: str) -> list[Token]:
    return [Token(m.lastgroup, m[0]) for m in _TOKEN.finditer(sql)]


def statements(sql: str) -> list[str]:
    """The statements of a text: cut at semicolons outside literals, comments and trigger bodies."""
    out, held, depth, create = [], [], 0, False
    for t in tokens(sql):
        solid = t.kind != "space"
        if solid and not any(x.kind != "space" for x in held):
            create, depth, held = t.word == "CREATE", 0, []
        if create and t.word == "TRIGGER":
            depth = max(depth, 0)
            create = "trigger"
        if create == "trigger" and t.word in ("BEGIN", "CASE"):
            depth += 1
        if create == "trigger" and t.word == "END":
            depth -= 1
        if t.text == ";" and t.kind == "sign" and depth <= 0:
            out.append("".join(x.text for x in held).strip())
            held = []
        elif solid or held:
            held.append(t)
    rest = "".join(x.text for x in held).strip()
    return [x for x in [*out, rest] if any(t.kind != "space" for t in tokens(x))]


def complete(text: str) -> bool:
    """Whether typed text ends a statement: its last token is a semicolon that is not inside something."""
    solid = [t for t in tokens(text) if t.kind != "space"]
    return bool(solid) and solid[-1].text == ";" and "'" not in [t.text for t in solid if t.kind == "other"] and (len(statements(text + " x")) > len(statements(text)))


def _next(ts: list[Token], k: int) -> int:
    k += 1
    while k < len(ts) and ts[k].kind == "space":
        k += 1
    return k


def _close(ts: list[Token], k: int) -> int:
    """Where the parenthesis that opens at k closes."""
    depth = 0
    for j in range(k, len(ts)):
        depth += {"(": 1, ")": -1}.get(ts[j].text, 0) if ts[j].kind == "sign" else 0
        if not depth:
            return j
    return len(ts) - 1


def _join(ts: list[Token]) -> str:
    return "".join(t.text for t in ts)


def _arguments(ts: list[Token]) -> list[list[Token]]:
    out, depth = [[]], 0
    for t in ts:
        depth += {"(": 1, ")": -1}.get(t.text, 0) if t.kind == "sign" else 0
        if t.text == "," and t.kind == "sign" and not depth:
            out.append([])
        else:
            out[-1].append(t)
    return out


def translate(sql: str, schemas=lambda name: None, args: list | None = None, facts: dict[str, int] | None = None) -> str:
    """One query for Spark; see query.Translator."""
    from logfold.query import Translator

    return Translator(sql, schemas, args, facts).translate()
