"""SQLite's date and time functions as Spark SQL over time stamps without a zone (UTC)."""

from __future__ import annotations

import re

from logfold.model import InvalidChangeError

_UNITS = {"second": "SECOND", "minute": "MINUTE", "hour": "HOUR", "day": "DAY"}
#: Fixed: strftime's letters as patterns of date_format.
_LETTERS = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "j": "DDD", "f": "ss.SSS", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "R": "HH:mm"}

Argument = tuple[str, str, str | None]  # text, kind, value of a text literal


def _months(ts: str, n: int) -> str:
    """Days beyond a month's end run over into the next."""
    first = f"CAST(date_trunc('MONTH', {ts}) AS TIMESTAMP_NTZ)"
    return f"timestampadd(DAY, datediff(timestampadd(MONTH, {n}, {first}), {first}), {ts})"


def _modified(ts: str, modifier: str) -> str:
    m = modifier.strip().lower()
    if m in ("utc", "localtime", "subsec", "subsecond", "auto"):
        return ts
    if found := re.fullmatch(r"start of (month|year|day)", m):
        return f"CAST(date_trunc('{found[1].upper()}', {ts}) AS TIMESTAMP_NTZ)"
    if found := re.fullmatch(r"weekday ([0-6])", m):  # on to that day, unless it is one
        return f"timestampadd(DAY, pmod({found[1]} - (dayofweek({ts}) - 1), 7), {ts})"
    if found := re.fullmatch(r"([-+]?\d+(?:\.\d+)?) (second|minute|hour|day|month|year)s?", m):
        n, unit = float(found[1]), found[2]
        if unit in _UNITS:
            if n == int(n):
                return f"timestampadd({_UNITS[unit]}, {int(n)}, {ts})"
            return f"timestampadd(MICROSECOND, {int(n * {'second': 1, 'minute': 60, 'hour': 3600, 'day': 86400}[unit] * 1_000_000)}L, {ts})"
        return _months(ts, int(n) * (12 if unit == "year" else 1))
    raise InvalidChangeError(f"cannot read the modifier {modifier}")


def _moment(args: list[Argument]) -> str:
    if not args:
        return "localtimestamp()"
    sql, kind, value = args[0]
    rest = [v for _, _, v in args[1:]]
    if any(v is None for v in rest):
        raise InvalidChangeError("a modifier must be written out")
    if value is not None and value.strip().lower() == "now":
        ts = "localtimestamp()"
    elif kind in ("int", "real"):
        seconds = f"({sql})" if rest[:1] and rest[0].lower() == "unixepoch" else f"(({sql} - 2440587.5D) * 86400)"
        rest = rest[1:] if rest[:1] and rest[0].lower() == "unixepoch" else rest
        ts = f"timestampadd(MICROSECOND, CAST(round({seconds} * 1000) * 1000 AS BIGINT), TIMESTAMP_NTZ'1970-01-01 00:00:00')"
    else:
        time_only = f"CASE WHEN {sql} RLIKE '^[0-9]{{2}}:[0-9]{{2}}' THEN concat('2000-01-01 ', {sql}) ELSE {sql} END"
        ts = f"try_cast({time_only} AS TIMESTAMP_NTZ)"
    for m in rest:
        ts = _modified(ts, m)
    return ts


def _seconds(ts: str) -> str:
    return f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts})"


def _julian(ts: str) -> str:
    return f"({_seconds(ts)} / 86400000000.0D + 2440587.5D)"


def _formatted(pattern: str, ts: str) -> str:
    parts, k, plain = [], 0, ""

    def text(s: str) -> str:
        return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"

    while k < len(pattern):
        c = pattern[k]
        if c != "%" or k + 1 == len(pattern):
            plain += c
            k += 1
            continue
        letter, k = pattern[k + 1], k + 2
        if letter == "%":
            plain += "%"
            continue
        if plain:
            parts.append(text(plain))
            plain = ""
        if letter in _LETTERS:
            parts.append(f"date_format({ts}, '{_LETTERS[letter]}')")
        elif letter == "s":
            parts.append(f"CAST({_seconds(ts)} div 1000000 AS STRING)")
        elif letter == "w":
            parts.append(f"CAST(dayofweek({ts}) - 1 AS STRING)")
        elif letter == "J":
            parts.append(f"CAST({_julian(ts)} AS STRING)")
        elif letter == "W":  # weeks from the first Monday
            parts.append(f"lpad(CAST((dayofyear({ts}) + 6 - weekday({ts})) div 7 AS STRING), 2, '0')")
        else:
            raise InvalidChangeError(f"cannot read %{letter}")
    if plain or not parts:
        parts.append(text(plain))
    return f"CASE WHEN {ts} IS NOT NULL THEN concat({', '.join(parts)}) END"


def date_function(name: str, args: list[Argument]) -> str:
    """The call as Spark SQL; null where a value is no time."""
    if name == "STRFTIME":
        if not args or args[0][2] is None:
            raise InvalidChangeError("strftime needs a format that is written out")
        return _formatted(args[0][2], _moment(args[1:]))
    ts = _moment(args)
    if name == "JULIANDAY":
        return _julian(ts)
    if name == "UNIXEPOCH":
        return f"({_seconds(ts)} div 1000000)"
    return f"date_format({ts}, '{ {'DATE': 'yyyy-MM-dd', 'TIME': 'HH:mm:ss', 'DATETIME': 'yyyy-MM-dd HH:mm:ss'}[name] }')"
