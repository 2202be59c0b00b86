"""The shell: statements until a semicolon, dot commands, tables as text; inspectors for files and logs."""

from __future__ import annotations

import sys
from collections import deque
from collections.abc import Iterable
from itertools import chain, islice

from pyspark.sql import DataFrame

from logfold import dialect
from logfold.engine import Engine

#: Rows that set the columns' widths; all rows are printed.
MEASURED = 1000
HISTORY = 5000
COMMANDS = (".addvoter", ".exit", ".help", ".load", ".quit", ".removevoter", ".schema", ".servers", ".snapshot", ".tables")


def render(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, (bytes, bytearray)):
        return f"<blob {len(value)} bytes>"
    return str(value)


def format_table(df: DataFrame | None, header: bool = True) -> str:
    """All rows as text; they come to the driver a partition at a time."""
    if df is None or not df.columns:
        return "OK"
    rows = ([render(v) for v in r] for r in df.toLocalIterator())
    lines = ([df.columns] if header else []) + list(islice(rows, MEASURED))
    width = [max((len(x[k]) for x in lines), default=0) for k in range(len(df.columns))]
    return "\n".join("  ".join(v.ljust(w) for v, w in zip(x, width)).rstrip() for x in chain(lines, rows))


class Shell:
    def __init__(self, engine: Engine):
        self.engine, self.text, self.done = engine, "", False
        self.history: deque[str] = deque(maxlen=HISTORY)

    def feed(self, line: str) -> str | None:
        """Takes a line; gives the output once a statement is complete."""
        if not self.text.strip() and line.strip().startswith("."):
            self.history.append(line.strip())
            return self.command(*line.split())
        self.text += line + "\n"
        if not dialect.complete(self.text):
            return None
        text, self.text = self.text, ""
        self.history.append(text.strip())
        try:
            return "\n".join(format_table(x) for x in self.engine.script(text))
        except Exception as e:
            return f"Error: {str(e).splitlines()[0] if str(e) else type(e).__name__}"

    def command(self, name: str, *args: str) -> str:
        try:
            if name in (".exit", ".quit"):
                self.done = True
                return ""
            if name == ".help":
                return "\n".join(COMMANDS)
            if name == ".tables":
                return "\n".join(self.engine.tables())
            if name == ".schema":
                return "\n".join(f"{self.engine.schema(t)};" for t in (args or self.engine.tables()))
            if name == ".load":
                with open(args[0]) as f:
                    return "\n".join(format_table(x) for x in self.engine.script(f.read()))
            if name == ".snapshot":
                return "\n".join(f"{t} {self.engine.table(t).compact()}" for t in self.engine.tables())
            if name in (".addvoter", ".removevoter", ".servers"):
                return "one coordinator; there are no voters"
            return f"unknown command {name}; .help lists them"
        except IndexError:
            return f"{name} needs an argument"
        except Exception as e:
            return f"Error: {str(e).splitlines()[0] if str(e) else type(e).__name__}"

    def run(self, lines: Iterable[str], out=sys.stdout) -> None:
        for line in lines:
            said = self.feed(line.rstrip("\n"))
            if said:
                print(said, file=out)
            if self.done:
                return
        if self.text.strip():
            print("Error: the last statement has no end", file=out)


class LineSink:
    """Keeps the newest lines; older ones are dropped, never waited for."""

    def __init__(self, size: int = 8192):
        self.lines: deque[str] = deque(maxlen=size)
        self.part = ""

    def write(self, text: str) -> int:
        *whole, self.part = (self.part + text).split("\n")
        self.lines.extend(whole)
        return len(text)


def members_to_tell(members: list[tuple[str, str]], own_id: str, own_address: str) -> list[str]:
    """Whom a member that moved has to tell: all others, in order; nobody if it is absent or has not moved."""
    known = dict(members)
    if known.get(own_id) in (None, own_address):
        return []
    return [a for i, a in sorted(members) if i != own_id]


def main(argv: list[str] | None = None) -> None:
    import argparse

    from logfold.session import get_session
    from logfold.sources import pages, wal

    p = argparse.ArgumentParser(prog="logfold")
    sub = p.add_subparsers(dest="what", required=True)
    sub.add_parser("shell").add_argument("root")
    sub.add_parser("waldump").add_argument("path")
    sub.add_parser("logdump").add_argument("path")
    d = sub.add_parser("dbdiff")
    d.add_argument("a")
    d.add_argument("b")
    g = sub.add_parser("pagedump")
    g.add_argument("path")
    g.add_argument("page", type=int)
    a = p.parse_args(argv)
    spark = get_session()
    if a.what == "shell":
        Shell(Engine(spark, a.root)).run(sys.stdin)
    elif a.what == "waldump":
        print(wal.header(a.path))
        f = wal.frames(spark, a.path)
        print(format_table(f.select("frame_no", "pg_no", "n_truncate", pages.hex_window(f.data).alias("first_bytes")).orderBy("frame_no")))
    elif a.what == "logdump":
        from logfold.store import LogStore

        found = LogStore(spark, a.path)
        print(format_table(found.scan()) if found.bounds()[1] else "empty")
    elif a.what == "dbdiff":
        print(format_table(pages.diff(pages.pages(spark, a.a), pages.pages(spark, a.b)).orderBy("pg_no")))
    else:
        print(pages.page_hex(pages.pages(spark, a.path), a.page))


if __name__ == "__main__":
    main()
