"""SQLite's queries as Spark's: a parser that knows each expression's storage class and writes Spark SQL for it.

Spark types are fixed before a query runs, SQLite's go with the value. The parser follows the kinds of columns (from the
tables' schemas) and literals, so division, comparison, concatenation and truth get SQLite's results. Where the class
depends on the value the wider one is taken: a text column in arithmetic counts as a real number. A sum of integer columns
beyond 64 bits is an error, not a real number; among literals it is one.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from logfold.dialect import Token, tokens
from logfold.functions.dates import date_function
from logfold.model import InvalidChangeError

Kinds = dict[str, str]
_NUMBERS = ("int", "real")
_SPARK = {"bigint": "int", "int": "int", "smallint": "int", "tinyint": "int", "double": "real", "float": "real", "string": "text", "binary": "blob", "boolean": "bool"}
_CAST = {"int": "BIGINT", "real": "DOUBLE", "text": "STRING", "blob": "BINARY"}
_ENDS = frozenset("FROM WHERE GROUP HAVING ORDER LIMIT UNION INTERSECT EXCEPT WINDOW ON USING JOIN LEFT RIGHT FULL INNER CROSS NATURAL OUTER AS AND OR NOT THEN ELSE END WHEN ASC DESC NULLS OFFSET BETWEEN IN IS LIKE GLOB ISNULL NOTNULL COLLATE ESCAPE FILTER OVER SET VALUES RETURNING".split())
_MATH = {"EXP": "exp", "LN": "ln", "LOG10": "log10", "LOG2": "log2", "SQRT": "sqrt", "SIN": "sin", "COS": "cos", "TAN": "tan", "ASIN": "asin", "ACOS": "acos", "ATAN": "atan", "SINH": "sinh", "COSH": "cosh", "TANH": "tanh", "ASINH": "asinh", "ACOSH": "acosh", "ATANH": "atanh", "DEGREES": "degrees", "RADIANS": "radians", "POW": "pow", "POWER": "pow", "ATAN2": "atan2"}
_RANKS = {"ROW_NUMBER": "int", "RANK": "int", "DENSE_RANK": "int", "NTILE": "int", "PERCENT_RANK": "real", "CUME_DIST": "real"}
_DATES = frozenset("DATE TIME DATETIME JULIANDAY UNIXEPOCH STRFTIME".split())


def kind_of(spark_type: str) -> str:
    return "real" if spark_type.startswith("decimal") else _SPARK.get(spark_type, "any")


def text_literal(s: str) -> str:
    plain = s.replace("\\", "\\\\").replace("'", "\\'")
    return "'" + re.sub(r"[\x00-\x1f]", lambda m: f"\\u{ord(m[0]):04x}", plain) + "'"


def literal(value) -> str:
    """A bound value as Spark SQL."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return f"{int(value)}L"
    if isinstance(value, int):
        return f"CAST('{value}' AS BIGINT)" if value == -(2**63) else f"{value}L"
    if isinstance(value, float):
        return f"{value!r}D"
    if isinstance(value, (bytes, bytearray)):
        return f"X'{bytes(value).hex()}'"
    return text_literal(str(value))


@dataclass
class E:
    sql: str
    kind: str
    affinity: bool = False  # a column or a cast
    value: object = field(default=None, repr=False)  # of a literal
    is_literal: bool = False
    column: str = ""


@dataclass
class Core:
    tables: list[tuple[str, Kinds]]
    calls: list[tuple[str, str]] = field(default_factory=list)  # aggregates met: name, argument
    inside: int = 0
    order: list[str] = field(default_factory=list)  # the order of the only subquery that is read from
    hidden: str = ""  # what that subquery has to give for it
    ordered: bool = False  # whether an aggregate asked for it
    aliases: Kinds = field(default_factory=dict)
    windows: dict[str, str] = field(default_factory=dict)

    def over(self, sql: str) -> str:
        """Named windows in their places."""
        return re.sub("\x05([^\x06]*)\x06", lambda m: self.windows.get(m[1].lower(), m[1]), sql)

    def by(self) -> list[str]:
        self.ordered = self.ordered or bool(self.order)
        return self.order


def lead_number(s: str) -> int | float:
    """The number a text begins with, 0 without one."""
    m = re.match(r"\s*([-+]?\d+(?![\d.eE])|[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)", s)
    if not m:
        return 0
    return int(m[1]) if re.fullmatch(r"[-+]?\d+", m[1]) else float(m[1])


def glob_regex(pattern: str) -> str:
    out, k = "", 0
    while k < len(pattern):
        c = pattern[k]
        if c == "[" and (end := pattern.find("]", k + 2)) > 0:
            out += f"[{pattern[k + 1 : end]}]".replace("\\", "\\\\")
            k = end
        else:
            out += {"*": "(?s:.*)", "?": "(?s:.)"}.get(c) or (c if c.isalnum() else "\\" + c)
        k += 1
    return f"^{out}\\z"


class Translator:
    """One query. ``schemas`` gives a table's columns and kinds, or None; ``args`` are bound in order; ``facts`` are the values
    of changes() and its like."""

    def __init__(self, sql: str, schemas: Callable[[str], Kinds | None] = lambda name: None, args: list | None = None, facts: dict[str, int] | None = None):
        self.ts = [t for t in tokens(sql) if t.kind != "space"]
        self.at, self.schemas, self.args, self.facts = 0, schemas, list(args or []), facts or {}
        self.bound = 0
        self.ctes: list[dict[str, Kinds]] = [{}]
        self.cores: list[Core] = []

    # Tokens.

    def peek(self, ahead: int = 0) -> str:
        k = self.at + ahead
        return self.ts[k].word if k < len(self.ts) else ""

    def next(self) -> Token:
        if self.at >= len(self.ts):
            raise InvalidChangeError("the statement ends too early")
        self.at += 1
        return self.ts[self.at - 1]

    def take(self, *words: str) -> bool:
        if all(self.peek(k) == w for k, w in enumerate(words)):
            self.at += len(words)
            return True
        return False

    def need(self, word: str) -> None:
        if not self.take(word):
            raise InvalidChangeError(f"{word} expected near {self.peek() or 'the end'}")

    def name(self) -> str:
        t = self.next()
        if t.kind == "text":
            return t.text[1:-1].replace("''", "'")
        if t.kind != "name":
            raise InvalidChangeError(f"a name expected near {t.text}")
        return t.text[1:-1].replace('""', '"') if t.text[0] in '"`[' else t.text

    @staticmethod
    def quoted(name: str) -> str:
        return name if re.fullmatch(r"[A-Za-z_]\w*", name) else "`" + name.replace("`", "``") + "`"

    # Queries.

    def translate(self) -> str:
        sql, _ = self.query()
        self.take(";")
        if self.at < len(self.ts):
            raise InvalidChangeError(f"cannot read from {self.peek()}")
        return sql

    def query(self) -> tuple[str, Kinds]:
        head = self.common() if self.peek() == "WITH" else ""
        sql, kinds, single = self.core()
        many = False
        while self.peek() in ("UNION", "INTERSECT", "EXCEPT"):
            sign = self.next().word + (" ALL" if self.take("ALL") else "")
            right, _, _ = self.core()
            sql, many = (f"({sql}) {sign} {right}" if many else f"{sql} {sign} {right}"), True
        tail = self.tail(single if not many else None, kinds)
        if head:
            self.ctes.pop()
        return head + sql + tail, kinds

    def common(self) -> str:
        self.need("WITH")
        recursive = self.take("RECURSIVE")
        self.ctes.append({})
        parts = []
        while True:
            name = self.name()
            columns = self.names() if self.peek() == "(" else []
            self.need("AS")
            self.take("NOT")
            self.take("MATERIALIZED")
            self.need("(")
            start, bound = self.at, self.bound
            if recursive:
                try:  # the kinds come from the part that doesn't recur
                    _, kinds, _ = self.core()
                    self.ctes[-1][name.lower()] = dict(zip(columns, kinds.values())) if columns else kinds
                except InvalidChangeError:
                    pass
                self.at, self.bound = start, bound
            sql, kinds = self.query()
            self.need(")")
            self.ctes[-1][name.lower()] = dict(zip(columns, kinds.values())) if columns else kinds
            parts.append(f"{self.quoted(name)}{'(' + ', '.join(map(self.quoted, columns)) + ')' if columns else ''} AS ({sql})")
            if not self.take(","):
                break
        return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(parts)} "

    def names(self) -> list[str]:
        self.need("(")
        out = [self.name()]
        while self.take(","):
            out.append(self.name())
        self.need(")")
        return out

    def core(self) -> tuple[str, Kinds, tuple[Core, list[str]] | None]:
        """Its text, kinds, and what an ORDER BY behind it needs."""
        if self.take("VALUES"):
            rows = []
            while True:
                self.need("(")
                rows.append(self.list())
                self.need(")")
                if not self.take(","):
                    break
            kinds = {f"column{k + 1}": next((r[k].kind for r in rows if r[k].kind != "null"), "null") for k in range(len(rows[0]))}
            wide = [self.wide([r[k].kind for r in rows]) for k in range(len(rows[0]))]
            body = ", ".join("(" + ", ".join(self.as_kind(e, w) for e, w in zip(r, wide)) + ")" for r in rows)
            return f"SELECT * FROM VALUES {body} AS _v({', '.join(kinds)})", kinds, None
        if self.take("("):
            sql, kinds = self.query()
            self.need(")")
            return f"({sql})", kinds, None
        self.need("SELECT")
        distinct = self.take("DISTINCT")
        self.take("ALL")
        items_at = self.at
        core = Core([])
        source = ""
        where_from = self.find_from()
        self.cores.append(core)
        if where_from is not None:
            self.at = where_from + 1
            source = f" FROM {self.sources(core)}"
        after = self.at
        self.at = items_at
        items, kinds = self.items(core)
        if where_from is not None:
            if self.at != where_from:
                raise InvalidChangeError(f"cannot read from {self.peek()}")
            self.at = after
        out = source
        if self.take("WHERE"):
            core.inside += 1  # rows, not groups
            out += f" WHERE {self.condition(self.expression())}"
            core.inside -= 1
        groups: list[str] = []
        if self.take("GROUP"):
            self.need("BY")
            for e in self.list():
                groups.append(self.group_term(e, items))
            out += f" GROUP BY {', '.join(groups)}"
        if self.take("HAVING"):
            out += f" HAVING {self.closed(self.condition(self.expression()), core, groups, True)}"
        if self.take("WINDOW"):
            while True:
                name = self.name()
                self.need("AS")
                core.windows[name.lower()] = self.strip(self.window())
                if not self.take(","):
                    break
        grouped = bool(groups) or bool(core.calls)
        out = out.replace("\x04", core.hidden if core.ordered else "")
        texts = []
        for sql, alias, own in items:
            text = core.over(self.closed(sql, core, groups, grouped))
            alias = alias or (own.column if text != self.strip(sql) else "")
            texts.append(text + (f" AS {self.quoted(alias)}" if alias else ""))
        self.cores.pop()
        return f"SELECT {'DISTINCT ' if distinct else ''}{', '.join(texts)}{out}", kinds, (core, groups)

    def group_term(self, e: E, items: list[tuple[str, str | None, E]]) -> str:
        if e.is_literal and isinstance(e.value, int):
            return str(e.value)
        plain = self.strip(e.sql)
        for sql, alias, own in items:
            if alias and e.column.lower() == alias.lower() and own.column.lower() != alias.lower() and not any(alias.lower() in (c.lower() for c in k) for _, k in self.cores[-1].tables):
                return self.strip(sql)
        return plain

    @staticmethod
    def strip(sql: str) -> str:
        return sql.replace("\x01", "").replace("\x02", "")

    def closed(self, sql: str, core: Core, groups: list[str], grouped: bool) -> str:
        """Text whose bare columns take the row of the only min or max, or any row, where rows are grouped."""
        if not grouped or self.strip(sql) in groups:
            return self.strip(sql)
        chosen = {c for c in core.calls if c[0] in ("max", "min")}

        def value(m: re.Match) -> str:
            if m[1] in groups or any(g.isdigit() for g in groups) and not core.calls:
                return m[1]
            if len(chosen) == 1:
                how, by = next(iter(chosen))
                return f"{how}_by({m[1]}, {by})"
            return m[1] if any(g.isdigit() for g in groups) else f"any_value({m[1]})"

        return re.sub("\x01([^\x01\x02]*)\x02", value, sql)

    def find_from(self) -> int | None:
        depth, cases = 0, 0
        for k in range(self.at, len(self.ts)):
            t = self.ts[k]
            if t.kind == "sign":
                depth += {"(": 1, ")": -1}.get(t.text, 0)
                if depth < 0 or t.text == ";":
                    return None
            elif not depth and t.kind == "name":
                if t.word == "FROM" and not (self.ts[k - 1].word == "DISTINCT" and self.ts[k - 2].word in ("IS", "NOT")):
                    return k
                if t.word in ("WHERE", "GROUP", "HAVING", "ORDER", "LIMIT", "UNION", "INTERSECT", "EXCEPT", "WINDOW") and not cases:
                    return None
        return None

    def items(self, core: Core) -> tuple[list[tuple[str, str | None, E]], Kinds]:
        out, kinds = [], {}
        while True:
            if self.take("*"):
                for _, columns in core.tables:
                    kinds |= {k: v for k, v in columns.items() if k not in kinds}
                out.append(("*", None, E("*", "any")))
            elif self.peek(1) == "." and self.peek(2) == "*":
                name = self.name()
                self.at += 2
                kinds |= next((c for a, c in core.tables if a.lower() == name.lower()), {})
                out.append((f"{self.quoted(name)}.*", None, E("*", "any")))
            else:
                first = self.at
                e = self.expression()
                alias = None
                if self.take("AS"):
                    alias = self.name()
                elif self.at < len(self.ts) and self.ts[self.at].kind in ("name", "text") and self.peek() not in _ENDS:
                    alias = self.name()
                named = alias or e.column or " ".join(t.text for t in self.ts[first : self.at])
                sql, kind = (f"CAST({e.sql} AS BIGINT)", "int") if e.kind == "bool" else (e.sql, e.kind)
                out.append((sql, None if e.column and not alias else named, e))
                kinds[named] = kind
                if alias:
                    core.aliases[alias.lower()] = kind
            if not self.take(","):
                return out, kinds

    def tail(self, single: tuple[Core, list[str]] | None, kinds: Kinds) -> str:
        out = ""
        self.order_terms: list[str] = []
        if self.take("ORDER"):
            self.need("BY")
            core, groups = single or (Core([]), [])
            self.cores.append(Core([*core.tables, ("", kinds)], core.calls, 0 if core.calls or groups else 1))
            terms = self.ordering()
            mine = self.cores.pop()
            if single and (mine.calls or groups):
                names = {k.lower() for k in kinds}
                terms = [t if re.sub(r"\s.*", "", self.strip(t)).strip("`").lower() in names else self.closed(t, core, groups, True) for t in terms]
            terms = [core.over(self.strip(t)) for t in terms]
            out += f" ORDER BY {', '.join(terms)}"
            self.order_terms = terms
        if self.take("LIMIT"):
            first = self.strip(self.expression().sql)
            if self.take(","):
                skip, first = first, self.strip(self.expression().sql)
            else:
                skip = self.strip(self.expression().sql) if self.take("OFFSET") else None
            whole = lambda s: re.sub(r"(\d)L\b", r"\1", s)
            if not first.startswith(("(-", "-")):  # a negative limit is none
                out += f" LIMIT {whole(first)}"
            if skip:
                out += f" OFFSET {whole(skip)}"
        return out

    def ordering(self) -> list[str]:
        out = []
        while True:
            e = self.expression()
            text = str(e.value) if e.is_literal and isinstance(e.value, int) else e.sql
            way = "DESC" if self.take("DESC") else "ASC"
            self.take("ASC")
            if self.take("NULLS"):
                nulls = self.next().word
            else:
                nulls = "FIRST" if way == "ASC" else "LAST"
            out.append(f"{text} {way} NULLS {nulls}")
            if not self.take(","):
                return out

    # Sources.

    def sources(self, core: Core) -> str:
        out = self.source(core)
        while True:
            if self.take(","):
                out += f" CROSS JOIN {self.source(core)}"
                continue
            words = []
            while self.peek() in ("NATURAL", "LEFT", "RIGHT", "FULL", "OUTER", "INNER", "CROSS", "JOIN"):
                words.append(self.next().word)
                if words[-1] == "JOIN":
                    break
            if not words:
                return out
            out += f" {' '.join(words)} {self.source(core)}"
            if self.take("ON"):
                core.inside += 1
                out += f" ON {self.condition(self.expression())}"
                core.inside -= 1
            elif self.peek() == "USING":
                self.at += 1
                out += f" USING ({', '.join(map(self.quoted, self.names()))})"

    def source(self, core: Core) -> str:
        if self.take("("):
            if self.peek() in ("SELECT", "WITH", "VALUES"):
                self.order_terms = []
                held, self.cores = self.cores, self.cores[:-1]
                sql, kinds = self.query()
                self.cores = held
                self.need(")")
                if self.order_terms and not core.tables and sql.startswith("SELECT ") and not sql.startswith("SELECT DISTINCT"):
                    ways = [re.search(r"^(.*) ((?:ASC|DESC) NULLS \w+)$", t, re.S) for t in self.order_terms]
                    if not any(w[1].isdigit() for w in ways):
                        core.order = [f"_o{k} {w[2]}" for k, w in enumerate(ways)]
                        core.hidden = "".join(f"{w[1]} AS _o{k}, " for k, w in enumerate(ways))
                        sql = "SELECT \x04" + sql[7:]
                return f"({sql}){self.alias(core, '', kinds)}"
            inner = self.sources(core)
            self.need(")")
            return f"({inner})"
        name = self.name()
        if self.peek() == "(" and name.upper() == "JSON_EACH":
            self.at += 1
            args = self.list()
            self.need(")")
            doc = self.text(args[0])
            if len(args) > 1:
                doc = f"get_json_object({doc}, {self.text(args[1])})"
            kinds = {"key": "text", "value": "text", "type": "text"}
            alias = self.alias(core, name, kinds).strip() or "json_each"
            alias = alias.removeprefix("AS ")
            each = "SELECT coalesce(key, CAST(pos AS STRING)) AS key, CAST(value AS STRING) AS value, " + self.json_kind("value") + f" AS type FROM variant_explode(try_parse_json({self.strip(doc)}))"
            return f"LATERAL ({each}) AS {alias}" if len(core.tables) > 1 else f"({each}) AS {alias}"
        if self.take("."):
            name = self.name()
        known = next((c[name.lower()] for c in reversed(self.ctes) if name.lower() in c), None)
        if known is None:
            known = self.schemas(name)
        return self.quoted(name) + self.alias(core, name, known or {})

    def alias(self, core: Core, name: str, kinds: Kinds) -> str:
        given = ""
        if self.take("AS"):
            given = self.name()
        elif self.at < len(self.ts) and self.ts[self.at].kind == "name" and self.peek() not in _ENDS:
            given = self.name()
        core.tables.append((given or name, kinds))
        return f" AS {self.quoted(given)}" if given else ""

    # Expressions, from the loosest binding to the tightest.

    def list(self) -> list[E]:
        out = [self.expression()]
        while self.take(","):
            out.append(self.expression())
        return out

    def expression(self) -> E:
        e = self.conjunction()
        while self.take("OR"):
            e = E(f"({self.condition(e)} OR {self.condition(self.conjunction())})", "bool")
        return e

    def conjunction(self) -> E:
        e = self.negation()
        while self.take("AND"):
            e = E(f"({self.condition(e)} AND {self.condition(self.negation())})", "bool")
        return e

    def negation(self) -> E:
        if self.peek() == "NOT" and self.peek(1) != "EXISTS":
            self.at += 1
            return E(f"(NOT {self.condition(self.negation())})", "bool")
        return self.equality()

    def equality(self) -> E:
        e = self.inequality()
        while True:
            w = self.peek()
            if w in ("=", "==", "<>", "!="):
                self.at += 1
                e = self.compare(e, "=" if w in ("=", "==") else "<>", self.inequality())
            elif w == "IS":
                e = self.is_test(e)
            elif w == "ISNULL" or w == "NOTNULL":
                self.at += 1
                e = E(f"({e.sql} IS {'NOT ' if w == 'NOTNULL' else ''}NULL)", "bool")
            elif w == "NOT" and self.peek(1) == "NULL":
                self.at += 2
                e = E(f"({e.sql} IS NOT NULL)", "bool")
            elif w in ("IN", "LIKE", "GLOB", "BETWEEN", "REGEXP") or w == "NOT" and self.peek(1) in ("IN", "LIKE", "GLOB", "BETWEEN", "REGEXP"):
                negative = self.take("NOT")
                found = self.membership(e, self.next().word)
                e = E(f"(NOT {found.sql})", "bool") if negative else found
            else:
                return e

    def is_test(self, e: E) -> E:
        self.need("IS")
        negative = self.take("NOT")
        if self.take("DISTINCT", "FROM"):
            negative = not negative
        elif self.peek() in ("TRUE", "FALSE") and self.peek(1) != "(":
            wanted = self.next().word == "TRUE"
            return E(f"({'NOT ' if negative else ''}coalesce({self.condition(e)} = {str(wanted).lower()}, false))", "bool")
        other = self.inequality()
        if other.is_literal and other.value is None:
            return E(f"({e.sql} IS {'NOT ' if negative else ''}NULL)", "bool")
        same = self.compare(e, "=", other)
        both = f"({e.sql} IS NULL AND {other.sql} IS NULL)"
        return E(f"({'NOT ' if negative else ''}({both} OR coalesce({same.sql}, false)))", "bool")

    def membership(self, e: E, word: str) -> E:
        if word == "BETWEEN":
            low = self.inequality()
            self.need("AND")
            high = self.inequality()
            return E(f"({self.compare(e, '>=', low).sql} AND {self.compare(e, '<=', high).sql})", "bool")
        if word in ("LIKE", "REGEXP"):
            pattern = self.inequality()
            if word == "REGEXP":
                return E(f"({self.text(e)} RLIKE {self.text(pattern)})", "bool")
            sign = self.text(self.inequality()) if self.take("ESCAPE") else "'\\u0001'"
            return E(f"({self.text(e)} ILIKE {self.text(pattern)} ESCAPE {sign})", "bool")
        if word == "GLOB":
            return self.glob(e, self.inequality())
        if not self.take("("):
            return E(f"({e.sql} IN (SELECT * FROM {self.quoted(self.name())}))", "bool")
        if self.peek() in ("SELECT", "WITH", "VALUES"):
            sql, kinds = self.query()
            self.need(")")
            own = next(iter(kinds.values()), "any")
            left = e.sql if e.kind == "row" else self.text(e) if own == "text" and e.kind in _NUMBERS and not e.affinity else e.sql
            return E(f"({left} IN ({sql}))", "bool")
        if self.take(")"):
            return E("false", "bool")
        found = self.list()
        self.need(")")
        if e.kind in ("row", "any") or all(x.kind in ("any", "null", "row") or (x.kind in _NUMBERS) == (e.kind in _NUMBERS) and (x.kind == "text") == (e.kind == "text") for x in found):
            return E(f"({e.sql} IN ({', '.join(x.sql for x in found)}))", "bool")
        return E("(" + " OR ".join(self.compare(e, "=", x, left_only=True).sql for x in found) + ")", "bool")

    def glob(self, e: E, pattern: E) -> E:
        if not (pattern.is_literal and isinstance(pattern.value, str)):
            raise InvalidChangeError("GLOB needs a pattern that is written out")
        return E(f"({self.text(e)} RLIKE {text_literal(glob_regex(pattern.value))})", "bool")

    def inequality(self) -> E:
        e = self.bits()
        while self.peek() in ("<", "<=", ">", ">="):
            sign = self.next().text
            e = self.compare(e, sign, self.bits())
        return e

    def bits(self) -> E:
        e = self.sums()
        while self.peek() in ("&", "|", "<<", ">>"):
            sign, other = self.next().text, self.sums()
            a, b = self.integer(e), self.integer(other)
            call = {"<<": f"shiftleft({a}, CAST({b} AS INT))", ">>": f"shiftright({a}, CAST({b} AS INT))"}
            e = E(call.get(sign) or f"({a} {sign} {b})", "int")
        return e

    def sums(self) -> E:
        e = self.products()
        while self.peek() in ("+", "-"):
            e = self.arithmetic(e, self.next().text, self.products())
        return e

    def products(self) -> E:
        e = self.joins()
        while self.peek() in ("*", "/", "%"):
            e = self.arithmetic(e, self.next().text, self.joins())
        return e

    def joins(self) -> E:
        e = self.collated()
        while self.peek() in ("||", "->", "->>"):
            sign, other = self.next().text, self.collated()
            if sign == "||":
                e = E(f"concat({self.text(e)}, {self.text(other)})", "text")
            else:
                path = self.path(other)
                e = E(f"get_json_object({self.text(e)}, {path})" if sign == "->>" else f"to_json(try_variant_get(try_parse_json({self.text(e)}), {path}, 'variant'))", "text")
        return e

    def path(self, e: E) -> str:
        if e.is_literal and isinstance(e.value, int):
            return text_literal(f"$[{e.value}]")
        if e.is_literal and isinstance(e.value, str):
            return text_literal(e.value if e.value.startswith("$") else f"$.{e.value}")
        return self.text(e)

    def collated(self) -> E:
        e = self.unary()
        while self.take("COLLATE"):
            how = {"NOCASE": "UTF8_LCASE", "RTRIM": "UTF8_BINARY_RTRIM"}.get(self.name().upper(), "UTF8_BINARY")
            e = E(f"({self.text(e)} COLLATE {how})", e.kind, e.affinity)
        return e

    def unary(self) -> E:
        if self.peek() in ("-", "+", "~"):
            sign = self.next().text
            if sign == "-" and self.peek() == str(2**63):
                self.at += 1
                return self.constant(-(2**63))
            e = self.unary()
            if sign == "+":
                return E(e.sql, e.kind, False, e.value, e.is_literal)
            if sign == "~":
                return E(f"(~{self.integer(e)})", "int")
            if e.is_literal and isinstance(e.value, (int, float)) and not isinstance(e.value, bool):
                return self.constant(-e.value)
            a, kind = self.number(e)
            return E(f"(-{a})", kind)
        return self.primary()

    # Operands.

    def constant(self, value) -> E:
        if isinstance(value, int) and not -(2**63) <= value < 2**63:
            value = float(value)
        kind = {int: "int", float: "real", str: "text", bytes: "blob", bytearray: "blob", bool: "int"}.get(type(value), "null")
        sql = literal(value)
        return E(f"({sql})" if sql.startswith("-") else sql, kind, False, int(value) if isinstance(value, bool) else value, True)

    def number(self, e: E) -> tuple[str, str]:
        """As a number, and its kind."""
        if e.kind in _NUMBERS:
            return e.sql, e.kind
        if e.kind == "bool":
            return f"CAST({e.sql} AS BIGINT)", "int"
        if e.is_literal and isinstance(e.value, str):
            n = self.constant(lead_number(e.value))
            return n.sql, n.kind
        if e.kind == "null":
            return "CAST(NULL AS BIGINT)", "int"
        if e.kind in ("text", "blob"):
            return self.lead(e, "real"), "real"
        return e.sql, "any"

    def lead(self, e: E, kind: str) -> str:
        """The number that a text begins with; null stays null."""
        x = f"CAST({e.sql} AS STRING)"
        pattern = r"^\s*([-+]?\d+)" if kind == "int" else r"^\s*([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)"
        return f"CASE WHEN {e.sql} IS NOT NULL THEN coalesce(try_cast(regexp_extract({x}, {text_literal(pattern)}, 1) AS {_CAST[kind]}), {'0L' if kind == 'int' else '0.0D'}) END"

    def integer(self, e: E) -> str:
        a, kind = self.number(e)
        return a if kind == "int" else f"CAST({a} AS BIGINT)"

    def text(self, e: E) -> str:
        if e.kind in ("text", "any"):
            return e.sql if e.kind == "text" else f"CAST({e.sql} AS STRING)"
        if e.kind == "bool":
            return f"CAST(CAST({e.sql} AS BIGINT) AS STRING)"
        return f"CAST({e.sql} AS STRING)"

    def condition(self, e: E) -> str:
        if e.kind == "bool":
            return e.sql
        if e.kind == "null":
            return "CAST(NULL AS BOOLEAN)"
        a, kind = self.number(e)
        return f"({a} <> 0)" if kind != "any" else f"CAST({a} AS BOOLEAN)"

    def plain(self, e: E) -> E:
        return E(f"CAST({e.sql} AS BIGINT)", "int") if e.kind == "bool" else e

    @staticmethod
    def wide(kinds: list[str]) -> str:
        found = {"int" if k == "bool" else k for k in kinds} - {"null"}
        if not found:
            return "null"
        if len(found) == 1:
            return next(iter(found))
        return "real" if found <= set(_NUMBERS) else "any" if "any" in found else "text"

    def as_kind(self, e: E, kind: str) -> str:
        if e.kind == kind or kind in ("any", "null") or e.kind == "null":
            return e.sql if e.kind != "bool" else f"CAST({e.sql} AS BIGINT)"
        return f"CAST({self.plain(e).sql} AS {_CAST[kind]})"

    def arithmetic(self, a: E, sign: str, b: E) -> E:
        if a.is_literal and b.is_literal and a.value is not None and b.value is not None and sign in "+-*":
            x, y = (lead_number(v.value) if isinstance(v.value, str) else v.value for v in (a, b))
            if isinstance(x, (int, float)) and isinstance(y, (int, float)):
                return self.constant(x + y if sign == "+" else x - y if sign == "-" else x * y)
        (x, p), (y, q) = self.number(a), self.number(b)
        whole = p == q == "int"
        kind = "int" if whole else "any" if "any" in (p, q) and "real" not in (p, q) else "real"
        if sign == "/":
            return E(f"({x} div nullif({y}, 0))" if whole else f"({x} / nullif({y}, 0))", kind)
        if sign == "%":
            i, j = (v if k == "int" else f"CAST({v} AS BIGINT)" for v, k in ((x, p), (y, q)))
            rest = f"({i} % nullif({j}, 0))"
            return E(rest if whole or kind == "any" else f"CAST({rest} AS DOUBLE)", kind)
        return E(f"({x} {sign} {y})", kind)

    def compare(self, a: E, sign: str, b: E, left_only: bool = False) -> E:
        a, b = self.plain(a), self.plain(b)
        if {a.kind, b.kind} & {"any", "null", "row"} or a.kind == b.kind or a.kind in _NUMBERS and b.kind in _NUMBERS:
            return E(f"({a.sql} {sign} {b.sql})", "bool")
        if "blob" in (a.kind, b.kind):
            less = b.kind == "blob"
        else:
            n, t = (a, b) if a.kind in _NUMBERS else (b, a)
            if n.affinity and not (left_only and n is b):
                way = f"({n.sql} {sign} try_cast(trim({t.sql}) AS DOUBLE))" if n is a else f"(try_cast(trim({t.sql}) AS DOUBLE) {sign} {n.sql})"
                other = self.constant_order(n, t, n is a, sign)
                return E(f"CASE WHEN try_cast(trim({t.sql}) AS DOUBLE) IS NOT NULL THEN {way} ELSE {other} END", "bool")
            if t.affinity:
                x, y = (f"CAST({v.sql} AS STRING)" if v is n else v.sql for v in (a, b))
                return E(f"({x} {sign} {y})", "bool")
            less = n is a
        return E(self.constant_order(a, b, less, sign), "bool")

    @staticmethod
    def constant_order(a: E, b: E, less: bool, sign: str) -> str:
        """The comparison of two storage classes, one below the other, unless a value is null."""
        said = sign == "<>" or sign in ("<", "<=") and less or sign in (">", ">=") and not less
        return f"CASE WHEN {a.sql} IS NOT NULL AND {b.sql} IS NOT NULL THEN {str(said).lower()} END"

    # Primaries.

    def primary(self) -> E:
        t = self.next()
        if t.kind == "number":
            return self.constant(float(t.text) if re.search(r"[.eE]", t.text) else int(t.text))
        if t.kind == "text":
            return self.constant(t.text[1:-1].replace("''", "'"))
        if t.kind == "blob":
            return self.constant(bytes.fromhex(t.text[2:-1]))
        if t.text == "?":
            k = self.bound
            if self.at < len(self.ts) and self.ts[self.at].kind == "number" and self.ts[self.at].text.isdigit():
                k = int(self.next().text) - 1
            self.bound = max(self.bound, k + 1)
            if k >= len(self.args):
                raise InvalidChangeError("a value is not bound")
            return self.constant(self.args[k])
        if t.text == "(":
            if self.peek() in ("SELECT", "WITH", "VALUES"):
                sql, kinds = self.query()
                self.need(")")
                return E(f"({sql})", next(iter(kinds.values()), "any"))
            found = self.list()
            self.need(")")
            if len(found) > 1:
                return E(f"({', '.join(x.sql for x in found)})", "row")
            e = found[0]
            return E(f"({e.sql})" if not e.is_literal else e.sql, e.kind, e.affinity, e.value, e.is_literal)
        if t.kind != "name":
            raise InvalidChangeError(f"cannot read {t.text}")
        w = t.word
        if w == "NULL":
            return self.constant(None)
        if w in ("TRUE", "FALSE") and self.peek() != "(":
            return self.constant(int(w == "TRUE"))
        if w == "CASE":
            return self.case()
        if w == "CAST" and self.peek() == "(":
            return self.cast()
        if w in ("EXISTS", "NOT") and (w == "EXISTS" or self.peek() == "EXISTS"):
            if w == "NOT":
                self.need("EXISTS")
            self.need("(")
            sql, _ = self.query()
            self.need(")")
            return E(f"({'NOT ' if w == 'NOT' else ''}EXISTS ({sql}))", "bool")
        if w in ("CURRENT_TIMESTAMP", "CURRENT_DATE", "CURRENT_TIME") and self.peek() != "(":
            return E(date_function({"CURRENT_TIMESTAMP": "DATETIME", "CURRENT_DATE": "DATE", "CURRENT_TIME": "TIME"}[w], []), "text")
        if self.peek() == "(" and t.text[0] not in '"`[':
            self.at += 1
            return self.call(w)
        self.at -= 1
        return self.column()

    def column(self) -> E:
        first = self.ts[self.at]
        parts = [self.name()]
        while self.take("."):
            parts.append(self.name())
        parts = parts[-2:]
        sql = ".".join(map(self.quoted, parts))
        for depth, core in enumerate(reversed(self.cores)):
            for alias, kinds in core.tables:
                if len(parts) == 2 and alias.lower() != parts[0].lower():
                    continue
                for name, kind in kinds.items():
                    if name.lower() == parts[-1].lower():
                        mark = depth == 0 and not core.inside
                        return E(f"\x01{sql}\x02" if mark else sql, kind, True, column=parts[-1])
        if self.cores and len(parts) == 1 and parts[0].lower() in self.cores[-1].aliases:
            return E(sql, self.cores[-1].aliases[parts[0].lower()], False, column=parts[0])
        if first.text[0] == '"' and len(parts) == 1 and any(k for c in self.cores for _, k in c.tables):
            return self.constant(parts[0])  # a name that nothing has is a text
        mark = self.cores and not self.cores[-1].inside
        return E(f"\x01{sql}\x02" if mark else sql, "any", True, column=parts[-1])

    def case(self) -> E:
        subject = None if self.peek() == "WHEN" else self.expression()
        arms: list[tuple[str, E]] = []
        other = None
        while self.take("WHEN"):
            e = self.expression()
            test = self.condition(e) if subject is None else self.compare(subject, "=", e).sql
            self.need("THEN")
            arms.append((test, self.plain(self.expression())))
        if self.take("ELSE"):
            other = self.plain(self.expression())
        self.need("END")
        kind = self.wide([e.kind for _, e in arms] + ([other.kind] if other else []))
        body = " ".join(f"WHEN {c} THEN {self.as_kind(e, kind)}" for c, e in arms)
        return E(f"CASE {body}{' ELSE ' + self.as_kind(other, kind) if other else ''} END", kind)

    def cast(self) -> E:
        self.need("(")
        e = self.plain(self.expression())
        self.need("AS")
        words = [self.next().word]
        while self.peek() != ")":
            words.append(self.next().word)
        self.at += 1
        name = " ".join(words)
        kind = "int" if "INT" in name else "text" if any(x in name for x in ("CHAR", "CLOB", "TEXT")) else "blob" if "BLOB" in name else "real"
        if e.kind == "null":
            return E(f"CAST(NULL AS {_CAST[kind]})", kind, True)
        if name in ("NUMERIC", "DECIMAL") and e.kind in _NUMBERS:
            return E(e.sql, e.kind, True)
        if kind in _NUMBERS and e.kind in ("text", "blob", "any"):
            if e.is_literal and isinstance(e.value, str):
                n = lead_number(e.value)
                m = re.match(r"\s*([-+]?\d+)", e.value)
                c = self.constant(int(m[1]) if kind == "int" and m else 0 if kind == "int" else float(n))
                return E(c.sql, kind, True)
            return E(self.lead(e, kind), kind, True)
        if kind == "blob":
            return E(f"CAST({self.text(e)} AS BINARY)" if e.kind != "blob" else e.sql, kind, True)
        return E(f"CAST({e.sql} AS {_CAST[kind]})", kind, True)

    # Calls.

    def call(self, name: str) -> E:
        core = self.cores[-1] if self.cores else Core([])
        if self.take("*"):
            self.need(")")
            args, distinct, order = [], False, []
        else:
            distinct = self.take("DISTINCT")
            may = name in _AGGREGATES and not self.is_scalar(name)
            core.inside += may
            args = [] if self.peek() == ")" else self.list()
            order = []
            if self.take("ORDER"):
                self.need("BY")
                order = self.ordering()
            core.inside -= may
            self.need(")")
        aggregate = name in _AGGREGATES and not (name in ("MAX", "MIN") and len(args) > 1)
        only = ""
        if self.peek() == "FILTER" and self.peek(1) == "(":
            self.at += 2
            self.need("WHERE")
            core.inside += 1
            only = f" FILTER (WHERE {self.condition(self.expression())})"
            core.inside -= 1
            self.need(")")
        args = [self.plain(a) for a in args]
        windowed = self.peek() == "OVER"
        if aggregate:
            made = self.aggregate(name, args, distinct, order, core, only)
            if not windowed:
                core.calls.append((name.lower() if len(args) == 1 and name in ("MAX", "MIN") and not only else "other", self.strip(args[0].sql) if args else ""))
                return made
        elif name in _RANKS:
            made = E(f"{name.lower()}({', '.join(f'CAST({a.sql} AS INT)' for a in args)})", _RANKS[name])
        elif name in ("LAG", "LEAD"):
            rest = [f"CAST({args[1].sql} AS INT)"] if len(args) > 1 else []
            made = E(f"{name.lower()}({', '.join([args[0].sql, *rest, *(a.sql for a in args[2:])])})", args[0].kind)
            made.sql = re.sub(r"CAST\((\d+)L AS INT\)", r"\1", made.sql)
        elif name in ("FIRST_VALUE", "LAST_VALUE", "NTH_VALUE"):
            made = E(f"{name.lower()}({', '.join([args[0].sql, *(re.sub(r'L$', '', a.sql) for a in args[1:])])})", args[0].kind)
        else:
            return self.scalar(name, args)
        if not windowed:
            raise InvalidChangeError(f"{name} needs OVER")
        self.at += 1
        over = self.window() if self.peek() == "(" else f"\x05{self.name()}\x06"
        sql = f"{made.sql} OVER {over}"
        if made.kind == "int" and name not in ("SUM", "MAX", "MIN", "LAG", "LEAD", "FIRST_VALUE", "LAST_VALUE", "NTH_VALUE"):
            sql = f"CAST({sql} AS BIGINT)"
        if name == "TOTAL":
            sql = f"coalesce(sum(CAST({args[0].sql} AS DOUBLE)) OVER {over}, 0.0D)"
        return E(sql, made.kind)

    def is_scalar(self, name: str) -> bool:
        """Whether max or min has more arguments than one, by a look ahead."""
        if name not in ("MAX", "MIN"):
            return False
        depth = 0
        for t in self.ts[self.at :]:
            if t.kind == "sign":
                if t.text == "," and not depth:
                    return True
                depth += {"(": 1, ")": -1}.get(t.text, 0)
                if depth < 0:
                    return False
        return False

    def window(self) -> str:
        self.need("(")
        parts = []
        if self.at < len(self.ts) and self.ts[self.at].kind == "name" and self.peek() not in ("PARTITION", "ORDER", "ROWS", "RANGE", "GROUPS"):
            parts.append(self.quoted(self.name()))
        if self.take("PARTITION"):
            self.need("BY")
            parts.append("PARTITION BY " + ", ".join(e.sql for e in self.list()))
        if self.take("ORDER"):
            self.need("BY")
            parts.append("ORDER BY " + ", ".join(self.ordering()))
        frame = []
        while self.peek() != ")":
            t = self.next()
            if t.word in ("GROUPS", "EXCLUDE") and not (t.word == "EXCLUDE" and self.take("NO", "OTHERS")):
                raise InvalidChangeError(f"{t.word} frames are not supported")
            if t.word != "EXCLUDE":
                frame.append(t.text)
        self.at += 1
        return f"({' '.join([*parts, *frame])})"

    def aggregate(self, name: str, args: list[E], distinct: bool, order: list[str], core: Core, only: str) -> E:
        if name == "COUNT":
            return E(f"count({'DISTINCT ' if distinct else ''}{args[0].sql if args else '*'}){only}", "int")
        a = args[0]
        if name in ("MAX", "MIN"):
            return E(f"{name.lower()}({a.sql}){only}", a.kind)
        if name in ("SUM", "TOTAL", "AVG"):
            x, kind = self.number(a)
            d = "DISTINCT " if distinct else ""
            if name == "SUM":
                return E(f"sum({d}{x}){only}", kind)
            x = f"{'avg' if name == 'AVG' else 'sum'}({d}CAST({x} AS DOUBLE)){only}"
            return E(x if name == "AVG" else f"coalesce({x}, 0.0D)", "real")
        if name in ("GROUP_CONCAT", "STRING_AGG"):
            sep = self.text(args[1]) if len(args) > 1 else "','"
            x = self.text(a)
            # without an order of its own: that of the subquery read from, else by value, so that runs agree
            by = order or core.by() or [f"{x} ASC NULLS FIRST"]
            return E(f"listagg({'DISTINCT ' if distinct else ''}{x}, {sep}) WITHIN GROUP (ORDER BY {x if distinct else ', '.join(by)}){only}", "text")
        if name == "JSON_GROUP_ARRAY":
            x = self.json_value(a)
            return E(f"concat('[', coalesce(listagg(coalesce({x}, 'null'), ',') WITHIN GROUP (ORDER BY {', '.join(order or core.by() or [x])}){only}, ''), ']')", "text")
        pair = f"concat({self.json_value(E(self.text(a), 'text'))}, ':', {self.json_value(args[1])})"
        return E(f"concat('{{', coalesce(listagg({pair}, ',') WITHIN GROUP (ORDER BY {', '.join(order or core.by() or [pair])}){only}, ''), '}}')", "text")

    def json_value(self, e: E) -> str:
        """An SQL value as JSON text; null is 'null'."""
        if e.kind in ("int", "real", "any"):
            return f"coalesce(CAST({e.sql} AS STRING), 'null')"
        if e.kind == "null":
            return "'null'"
        j = f"to_json(array({self.text(e)}))"
        return f"CASE WHEN {e.sql} IS NULL THEN 'null' ELSE substr({j}, 2, length({j}) - 2) END"

    @staticmethod
    def json_kind(variant: str) -> str:
        s = f"schema_of_variant({variant})"
        return f"CASE WHEN {s} LIKE 'ARRAY%' THEN 'array' WHEN {s} LIKE 'OBJECT%' THEN 'object' WHEN {s} = 'BOOLEAN' THEN CAST({variant} AS STRING) WHEN {s} = 'VOID' THEN 'null' WHEN {s} = 'BIGINT' THEN 'integer' WHEN {s} = 'STRING' THEN 'text' ELSE 'real' END"

    def scalar(self, name: str, args: list[E]) -> E:
        n = len(args)
        if name in _DATES:
            rest = [a.value if a.is_literal and isinstance(a.value, str) else None for a in args]
            return E(date_function(name, [(a.sql, a.kind, r) for a, r in zip(args, rest)]), {"JULIANDAY": "real", "UNIXEPOCH": "int"}.get(name, "text"))
        if name in _MATH:
            return E(f"{_MATH[name]}({', '.join(f'CAST({self.number(a)[0]} AS DOUBLE)' for a in args)})", "real")
        if name in ("CHANGES", "TOTAL_CHANGES", "LAST_INSERT_ROWID"):
            return self.constant(self.facts.get(name, 0))
        if name == "PI":
            return E("pi()", "real")
        if not n:
            raise InvalidChangeError(f"{name} needs an argument")
        a = args[0]
        s = self.text(a)
        if name in ("COALESCE", "IFNULL"):
            kind = self.wide([x.kind for x in args])
            return E(f"coalesce({', '.join(self.as_kind(x, kind) for x in args)})", kind)
        if name == "NULLIF":
            return E(f"CASE WHEN coalesce({self.compare(a, '=', args[1]).sql}, false) THEN NULL ELSE {a.sql} END", a.kind)
        if name in ("IIF", "IF"):
            rest = [*args[1:], self.constant(None)][:2]
            kind = self.wide([x.kind for x in rest])
            return E(f"CASE WHEN {self.condition(a)} THEN {self.as_kind(rest[0], kind)} ELSE {self.as_kind(rest[1], kind)} END", kind)
        if name in ("MAX", "MIN"):
            kind = self.wide([x.kind for x in args])
            xs = [self.as_kind(x, kind) for x in args]
            return E(f"CASE WHEN {' AND '.join(f'{x} IS NOT NULL' for x in xs)} THEN {'greatest' if name == 'MAX' else 'least'}({', '.join(xs)}) END", kind)
        if name == "TYPEOF":
            kind = {"int": "integer", "real": "real", "text": "text", "blob": "blob", "null": "null"}.get(a.kind)
            if kind is None:
                kind = f"CASE typeof({a.sql}) WHEN 'bigint' THEN 'integer' WHEN 'int' THEN 'integer' WHEN 'double' THEN 'real' WHEN 'binary' THEN 'blob' ELSE 'text' END"
                return E(f"CASE WHEN {a.sql} IS NULL THEN 'null' ELSE {kind} END", "text")
            return E(f"CASE WHEN {a.sql} IS NULL THEN 'null' ELSE '{kind}' END", "text")
        if name == "ABS":
            x, kind = self.number(a)
            return E(f"abs({x})", kind)
        if name == "ROUND":
            digits = f", {args[1].value}" if n > 1 and args[1].is_literal else f", CAST({self.integer(args[1])} AS INT)" if n > 1 else ""
            return E(f"round(CAST({self.number(a)[0]} AS DOUBLE){digits})", "real")
        if name == "SIGN":
            return E(f"CAST(sign({self.number(a)[0]}) AS BIGINT)", "int")
        if name in ("CEIL", "CEILING", "FLOOR", "TRUNC"):
            x, kind = self.number(a)
            if kind == "int":
                return E(x, "int")
            call = f"CASE WHEN {x} < 0 THEN ceil({x}) ELSE floor({x}) END" if name == "TRUNC" else f"{'floor' if name == 'FLOOR' else 'ceil'}({x})"
            return E(f"CAST({call} AS DOUBLE)", "real")
        if name == "LOG":
            return E(f"log10(CAST({self.number(a)[0]} AS DOUBLE))" if n == 1 else f"(ln(CAST({self.number(args[1])[0]} AS DOUBLE)) / ln(CAST({self.number(a)[0]} AS DOUBLE)))", "real")
        if name == "MOD":
            x, y = (f"CAST({self.number(v)[0]} AS DOUBLE)" for v in args)
            return E(f"({x} % nullif({y}, 0.0D))", "real")
        if name == "LENGTH" or name == "OCTET_LENGTH":
            return E(f"CAST({'octet_length' if name != 'LENGTH' or a.kind == 'blob' else 'length'}({a.sql if a.kind == 'blob' else s}) AS BIGINT)", "int")
        if name in ("LOWER", "UPPER"):
            big, small = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
            return E(f"translate({s}, '{big if name == 'LOWER' else small}', '{small if name == 'LOWER' else big}')", "text")
        if name in ("TRIM", "LTRIM", "RTRIM"):
            side = {"TRIM": "BOTH", "LTRIM": "LEADING", "RTRIM": "TRAILING"}[name]
            return E(f"trim({side} {self.text(args[1]) if n > 1 else chr(39) + ' ' + chr(39)} FROM {s})", "text")
        if name == "REPLACE":
            return E(f"replace({s}, {self.text(args[1])}, {self.text(args[2])})", "text")
        if name in ("SUBSTR", "SUBSTRING"):
            return self.substr(a, args[1], args[2] if n > 2 else None)
        if name == "INSTR":
            return E(f"CAST(instr({s}, {self.text(args[1])}) AS BIGINT)", "int")
        if name == "HEX":
            return E(f"coalesce(hex({a.sql if a.kind == 'blob' else s}), '')", "text")
        if name == "UNHEX":
            return E(f"unhex({s})", "blob")
        if name == "QUOTE":
            if a.kind in _NUMBERS:
                return E(f"coalesce({s}, 'NULL')", "text")
            if a.kind == "blob":
                return E(f"coalesce(concat('X\\'', hex({a.sql}), '\\''), 'NULL')", "text")
            return E(f"coalesce(concat('\\'', replace({s}, '\\'', '\\'\\''), '\\''), 'NULL')", "text")
        if name == "UNICODE":
            return E(f"CASE WHEN {s} <> '' THEN CAST(ascii({s}) AS BIGINT) END", "int")
        if name == "CHAR":
            return E("concat(" + ", ".join(f"decode(unhex(lpad(hex({self.integer(x)}), 8, '0')), 'UTF-32')" for x in args) + ")", "text")
        if name == "SOUNDEX":
            return E(f"CASE WHEN {s} RLIKE '[A-Za-z]' THEN soundex({s}) ELSE '?000' END", "text")
        if name in ("PRINTF", "FORMAT"):
            kinds = [m[1] for m in re.finditer(r"%[-+ 0,#]*\d*(?:\.\d+)?([a-zA-Z%])", str(a.value)) if m[1] != "%"]
            cast = {"d": self.integer, "i": self.integer, "x": self.integer, "X": self.integer, "o": self.integer, "f": lambda e: f"CAST({self.number(e)[0]} AS DOUBLE)"}
            cast |= {"e": cast["f"], "g": cast["f"], "E": cast["f"], "G": cast["f"]}
            rest = [cast.get(k, self.text)(x) for x, k in zip(args[1:], [*kinds, *("s" for _ in args)])]
            return E(f"format_string({', '.join([s.replace('%i', '%d'), *rest])})", "text")
        if name == "LIKE":
            return E(f"({self.text(args[1])} ILIKE {s} ESCAPE {self.text(args[2]) if n > 2 else chr(39) + chr(92) + 'u0001' + chr(39)})", "bool")
        if name == "GLOB":
            return self.glob(args[1], a)
        if name == "ZEROBLOB":
            return E(f"unhex(repeat('00', CAST({self.integer(a)} AS INT)))", "blob")
        if name == "RANDOMBLOB":
            m = f"CAST({self.integer(a)} AS INT)"
            return E(f"unhex(substr(repeat(replace(uuid(), '-', ''), {m} div 16 + 1), 1, {m} * 2))", "blob")
        if name in ("LIKELY", "UNLIKELY"):
            return a
        if name.startswith("JSON"):
            return self.json(name, args)
        raise InvalidChangeError(f"no such function: {name.lower()}")

    def substr(self, a: E, start: E, length: E | None) -> E:
        """Position 0 stands before the first character; negative ones count from the end; a negative length takes what
        stands before the position."""
        blob = a.kind == "blob"
        s = a.sql if blob else self.text(a)
        size = f"{'octet_length' if blob else 'length'}({s})"
        p = self.integer(start)
        first = f"CASE WHEN {p} >= 0 THEN {p} ELSE {size} + {p} + 1 END"
        if length is None:
            low, high = first, f"{size} + 1"
        else:
            m = self.integer(length)
            low, high = f"least({first}, {first} + {m})", f"greatest({first}, {first} + {m})"
        low = f"greatest({low}, 1)"
        return E(f"substr({s}, CAST({low} AS INT), CAST(greatest(least({high}, {size} + 1) - {low}, 0) AS INT))", a.kind if blob else "text")

    def json(self, name: str, args: list[E]) -> E:
        a = args[0]
        doc = self.text(a)
        if name == "JSON":
            return E(f"to_json(parse_json({doc}))", "text")
        if name == "JSON_VALID":
            return E(f"CASE WHEN {doc} IS NOT NULL THEN CAST(try_parse_json({doc}) IS NOT NULL AS BIGINT) END", "int")
        if name == "JSON_EXTRACT":
            if len(args) == 2:
                return E(f"get_json_object({doc}, {self.path(args[1])})", "text")
            return E("concat('[', " + ", ',', ".join(f"coalesce(to_json(try_variant_get(try_parse_json({doc}), {self.path(p)}, 'variant')), 'null')" for p in args[1:]) + ", ']')", "text")
        if name == "JSON_TYPE":
            v = f"try_parse_json({doc})" if len(args) == 1 else f"try_variant_get(try_parse_json({doc}), {self.path(args[1])}, 'variant')"
            return E(self.json_kind(v), "text")
        if name == "JSON_ARRAY_LENGTH":
            return E(f"CAST(json_array_length({doc if len(args) == 1 else f'get_json_object({doc}, {self.path(args[1])})'}) AS BIGINT)", "int")
        if name == "JSON_QUOTE":
            return E(self.json_value(a), "text")
        if name == "JSON_ARRAY":
            return E("concat('[', " + ", ',', ".join(map(self.json_value, args)) + ", ']')", "text")
        if name == "JSON_OBJECT":
            pairs = [f"concat({self.json_value(k)}, ':', {self.json_value(v)})" for k, v in zip(args[::2], args[1::2])]
            return E("concat('{', " + ", ',', ".join(pairs) + ", '}')", "text")
        raise InvalidChangeError(f"no such function: {name.lower()}")


_AGGREGATES = frozenset("COUNT SUM TOTAL AVG MIN MAX GROUP_CONCAT STRING_AGG JSON_GROUP_ARRAY JSON_GROUP_OBJECT".split())
