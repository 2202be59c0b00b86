"""Column functions with the results that SQLite gives where Spark's own differ."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

ColumnOrName = Column | str


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def integer_division(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Towards zero, and null over zero."""
    a, b = _c(a).cast("long"), _c(b).cast("long")
    return F.when(b != 0, F.call_function("div", a, F.when(b != 0, b)))


def division(a: ColumnOrName, b: ColumnOrName) -> Column:
    return F.try_divide(_c(a).cast("double"), _c(b).cast("double"))


def to_integer(x: ColumnOrName) -> Column:
    """The leading digits of a text as a number, 0 if there are none."""
    lead = F.regexp_extract(_c(x).cast("string"), r"^\s*([-+]?\d+)", 1)
    return F.when(_c(x).isNotNull(), F.coalesce(lead.try_cast("long"), F.lit(0)))


def add(a: ColumnOrName, b: ColumnOrName) -> Column:
    """An integer sum, or a real one where it overflows."""
    a, b = _c(a), _c(b)
    exact = F.try_add(a.cast("long"), b.cast("long"))
    return F.when(exact.isNotNull(), exact.cast("double")).otherwise(a.cast("double") + b.cast("double"))


def round_real(x: ColumnOrName, digits: int = 0) -> Column:
    return F.round(_c(x).cast("double"), digits)


def substr(s: ColumnOrName, start: int, length: int | None = None) -> Column:
    """Position 0 stands before the first character; negative positions count from the end; a negative length takes the
    characters before the position."""
    s = _c(s)
    n = F.length(s)
    first = F.lit(start) if start >= 0 else n + start + 1
    a, b = (first, n + 1) if length is None else (first, first + length) if length >= 0 else (first + length, first)
    a, b = F.greatest(a, F.lit(1)), F.least(b, n + 1)
    return F.when(s.isNotNull(), F.substring(s, a, F.greatest(b - a, F.lit(0))))


def scalar_max(*xs: ColumnOrName) -> Column:
    """Null if any argument is."""
    return _strict(F.greatest, xs)


def scalar_min(*xs: ColumnOrName) -> Column:
    return _strict(F.least, xs)


def _strict(f, xs) -> Column:
    xs = [_c(x) for x in xs]
    known = xs[0].isNotNull()
    for x in xs[1:]:
        known = known & x.isNotNull()
    return F.when(known, f(*xs))


def total(x: ColumnOrName) -> Column:
    return F.coalesce(F.sum(_c(x).cast("double")), F.lit(0.0))


def group_concat(x: ColumnOrName, order: ColumnOrName, sep: str = ",") -> Column:
    """Null over no rows, as nulls are left out."""
    items = F.array_sort(F.collect_list(F.when(_c(x).isNotNull(), F.struct(_c(order).alias("o"), _c(x).cast("string").alias("x")))))
    return F.when(F.size(items) > 0, F.array_join(F.transform(items, lambda i: i["x"]), sep))


def like(s: ColumnOrName, pattern: str) -> Column:
    return _c(s).ilike(pattern).cast("int")


def glob(s: ColumnOrName, pattern: str) -> Column:
    """Shell patterns, by case."""
    out, k = "", 0
    while k < len(pattern):
        c = pattern[k]
        if c == "[" and (end := pattern.find("]", k + 2)) > 0:
            inside = pattern[k + 1 : end].replace("\\", "\\\\")
            out += f"[{inside}]"
            k = end
        else:
            out += {"*": "(?s:.*)", "?": "(?s:.)"}.get(c) or (c if c.isalnum() else "\\" + c)
        k += 1
    return _c(s).rlike(f"^{out}\\z").cast("int")


def quote(x: ColumnOrName) -> Column:
    x = _c(x)
    return F.when(x.isNull(), "NULL").otherwise(F.concat(F.lit("'"), F.replace(x.cast("string"), F.lit("'"), F.lit("''")), F.lit("'")))


def zeroblob(n: int) -> Column:
    return F.unhex(F.lit("00" * n))


def seeded_blob(n: int, seed: ColumnOrName) -> Column:
    """n bytes that depend on the seed only."""
    parts = [F.sha2(F.concat_ws(":", _c(seed).cast("string"), F.lit(str(k))), 256) for k in range(-(-n // 32))]
    return F.unhex(F.substring(F.concat(*parts), 1, 2 * n))
