"""Statements over versioned tables: DDL, DML, triggers, transactions and queries of the SQLite dialect.

A statement's triggers run over all its rows at once: a body's INSERT takes a row for each changed row, its DELETE all rows
that match any of them, its UPDATE, for each row, the first changed row that matches, and RAISE looks for any row that
reaches it. For statements that change one row this is SQLite's order; for others the results are those of its row order
wherever a body's condition fails once a row has been changed by it. A statement and its triggers are one commit over all
tables that they change, as is a transaction.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from logfold import dialect
from logfold.dialect import Token
from logfold.model import CommitError, ConstraintError, InvalidChangeError, NotFoundError
from logfold.query import kind_of
from logfold.table import DROP, KEEP, Files, Manifest, Table

_TYPES = {"INTEGER": "long", "INT": "long", "TEXT": "string", "BLOB": "binary", "REAL": "double"}
_ROWS = re.compile(r"INSERT\s+(?P<replace>OR\s+REPLACE\s+)?(?P<ignore>OR\s+IGNORE\s+)?INTO\s+(?P<table>\w+)\s*(?:\((?P<columns>[^)]*)\))?\s*(?P<source>(?:VALUES|SELECT|WITH|DEFAULT\s+VALUES)\b.*?)(?:\s+ON\s+CONFLICT\s*(?:\([^)]*\))?\s*DO\s+(?P<conflict>NOTHING|UPDATE\s+SET\s+.*))?$", re.I | re.S)
_UPDATE = re.compile(r"UPDATE\s+(\w+)\s+SET\s+(.*)$", re.I | re.S)
_DELETE = re.compile(r"DELETE\s+FROM\s+(\w+)(?:\s+WHERE\s+(.*))?$", re.I | re.S)
_CREATE = re.compile(r"CREATE\s+TABLE\s+(?P<soft>IF\s+NOT\s+EXISTS\s+)?(?P<table>\w+)\s*\((?P<body>.*)\)\s*(?:STRICT|WITHOUT\s+ROWID|,|\s)*$", re.I | re.S)
_TRIGGER = re.compile(r"CREATE\s+TRIGGER\s+(?:IF\s+NOT\s+EXISTS\s+)?(?P<name>\w+)\s+(?P<when>BEFORE\s+|AFTER\s+)?(?P<verb>INSERT|DELETE|UPDATE)(?:\s+OF\s+(?P<columns>[\w\s,]+?))?\s+ON\s+(?P<table>\w+)\s*(?:FOR\s+EACH\s+ROW\s*)?(?:WHEN\s+(?P<test>.*?)\s*)?\bBEGIN\b(?P<body>.*)\bEND\s*$", re.I | re.S)
#: Triggers that fire triggers, at most.
DEPTH = 16


@dataclass
class Trigger:
    name: str
    before: bool
    verb: str
    columns: list[str]
    test: str
    body: list[str]

    @classmethod
    def of(cls, text: str) -> Trigger:
        m = _TRIGGER.match(text.strip())
        if not m:
            raise InvalidChangeError(f"cannot read {text[:60]}")
        columns = [c.strip().lower() for c in (m["columns"] or "").split(",") if c.strip()]
        return cls(m["name"], (m["when"] or "BEFORE").strip().upper() == "BEFORE", m["verb"].upper(), columns, m["test"] or "1", dialect.statements(m["body"]))


def _parts(text: str) -> list[str]:
    return [dialect._join(a).strip() for a in dialect._arguments(dialect.tokens(text))]


def _where(text: str) -> tuple[str, str]:
    """SET list and condition of what follows SET."""
    ts, depth = dialect.tokens(text), 0
    for k, t in enumerate(ts):
        depth += {"(": 1, ")": -1}.get(t.text, 0) if t.kind == "sign" else 0
        if not depth and t.word == "WHERE" and t.kind == "name":
            return dialect._join(ts[:k]), dialect._join(ts[k + 1 :])
    return text, "1"


def _sets(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] for m in (re.match(r"\s*[`\"]?(\w+)[`\"]?\s*=\s*(.*)", x, re.S) for x in _parts(text))}


def _qualified(sql: str, names: set[str], table: str) -> str:
    """Bare columns of a table with its name in front."""
    ts = dialect.tokens(sql)
    solid = [k for k, t in enumerate(ts) if t.kind != "space"]
    out = list(ts)
    for i, k in enumerate(solid):
        t = ts[k]
        before = ts[solid[i - 1]].text if i else ""
        after = ts[solid[i + 1]].text if i + 1 < len(solid) else ""
        if t.kind == "name" and t.text.strip('"`[]').lower() in names and before != "." and after not in (".", "("):
            out[k] = Token("name", f"{table}.{t.text}")
    return dialect._join(out)


def _rows_of(sql: str) -> str:
    """NEW.x and OLD.x as columns of the changed rows."""
    return re.sub(r"\b(NEW|OLD)\s*\.\s*[`\"]?(\w+)[`\"]?", lambda m: f"_changed.{m[1].lower()}_{m[2].lower()}", sql, flags=re.I)


class Engine:
    """A folder of tables. Queries see one version of each table; a transaction keeps it until commit or rollback."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 16):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self.pinned: dict[str, int] | None = None
        self.staged: dict[str, DataFrame] = {}
        self.savepoints: list[tuple[str, dict[str, DataFrame]]] = []
        self.changes = self.total_changes = self.last_insert_rowid = 0
        self.files = Files(spark, self.root)
        self._stage: list[str] = []  # what staged rows read until the transaction ends
        self._names: list[str] | None = None  # the tables there are, while a statement runs

    def table(self, name: str) -> Table:
        found = next((t for t in self.tables() if t.lower() == name.lower()), name)
        return Table.open(self.spark, f"{self.root}/{found}")

    def tables(self) -> list[str]:
        if self._names is not None:
            return self._names
        return sorted(n for n in self.files.names(self.root) if self.files.names(f"{self.root}/{n}/_log"))

    def schema(self, name: str) -> str:
        m = self.table(name).manifest()
        kinds = {v: k for k, v in _TYPES.items() if k != "INT"} | {"bigint": "INTEGER"}
        body = ", ".join(f"{f.name} {kinds.get(f.dataType.simpleString(), f.dataType.simpleString().upper())}" + (" PRIMARY KEY" if f.name == m.key else " NOT NULL" if f.name in m.not_null else "") for f in StructType.fromDDL(m.schema))
        return ";\n".join([f"CREATE TABLE {name}({body})", *m.triggers])

    def catalog(self) -> DataFrame:
        """type, name, tbl_name and sql of every table and trigger."""
        rows = []
        for t in self.tables():
            rows.append(("table", t, t, self.schema(t).split(";\n")[0]))
            rows += [("trigger", Trigger.of(x).name, t, x) for x in self.table(t).manifest().triggers]
        return self.spark.createDataFrame(rows, "type string, name string, tbl_name string, sql string")

    def script(self, text: str) -> list[DataFrame | None]:
        return [self.execute(s) for s in dialect.statements(text)]

    def execute(self, sql: str, args: list | None = None) -> DataFrame | None:
        """Runs one statement. Queries give a DataFrame, others None and set ``changes``."""
        text = dialect.statements(sql)
        if len(text) != 1:
            raise InvalidChangeError("one statement at a time")
        text = text[0]
        words = [t.word for t in dialect.tokens(text) if t.kind != "space"]
        verb = words[0]
        if verb in ("SELECT", "WITH", "VALUES"):
            return self.query(text, args)
        if verb in ("BEGIN", "COMMIT", "END", "ROLLBACK", "SAVEPOINT", "RELEASE"):
            return self._transaction(verb, words)
        if verb == "CREATE":
            return self._create(text)
        if verb == "DROP":
            return self._drop(words)
        if verb == "PRAGMA":
            return self._pragma(text)
        if verb in ("INSERT", "REPLACE", "UPDATE", "DELETE"):
            return self._statement(verb, text, args)
        raise InvalidChangeError(f"unknown statement {verb}")

    def query(self, sql: str, args: list | None = None, views: dict[str, DataFrame] | None = None) -> DataFrame:
        names = {t.text.strip('"`[]').lower() for t in dialect.tokens(sql) if t.kind == "name"}
        frames = {n.lower(): self._current(n) for n in self.tables() if n.lower() in names}
        if names & {"sqlite_master", "sqlite_schema"}:
            frames |= {"sqlite_master": self.catalog(), "sqlite_schema": self.catalog()}
        frames |= views or {}
        for name, df in frames.items():
            df.createOrReplaceTempView(name)
        kinds = {n: {f.name: kind_of(f.dataType.simpleString()) for f in df.schema} for n, df in frames.items()}
        facts = {"CHANGES": self.changes, "TOTAL_CHANGES": self.total_changes, "LAST_INSERT_ROWID": self.last_insert_rowid}
        return self.spark.sql(dialect.translate(sql, lambda n: kinds.get(n.lower()), args, facts))

    def _current(self, name: str) -> DataFrame:
        name = next((t for t in self.tables() if t.lower() == name.lower()), name)
        if name in self.staged:
            return self.staged[name]
        t = self.table(name)
        return t.read(self.pinned.setdefault(name, t.version) if self.pinned is not None else None)

    # Transactions.

    def _transaction(self, verb: str, words: list[str]) -> None:
        if verb == "BEGIN":
            if self.pinned is not None:
                raise InvalidChangeError("a transaction is open")
            self.pinned, self.staged, self.savepoints = {}, {}, []
            if words[1:2] and words[1] in ("IMMEDIATE", "EXCLUSIVE"):  # the versions that it starts from are fixed now
                self.pinned = {n: self.table(n).version for n in self.tables()}
            return
        if verb == "SAVEPOINT":
            if self.pinned is None:
                self.pinned, self.staged, self.savepoints = {}, {}, []
            self.savepoints.append((words[1], dict(self.staged)))
            return
        if self.pinned is None:
            raise InvalidChangeError("no transaction is open")
        if verb == "RELEASE" or verb == "ROLLBACK" and "TO" in words:
            name = words[-1]
            at = next((k for k in range(len(self.savepoints) - 1, -1, -1) if self.savepoints[k][0] == name), None)
            if at is None:
                raise InvalidChangeError(f"no such savepoint: {name}")
            if verb == "RELEASE":
                del self.savepoints[at:]
            else:
                self.staged = dict(self.savepoints[at][1])
                del self.savepoints[at + 1 :]
            return
        staged, pinned = self.staged, self.pinned
        self.staged, self.pinned, self.savepoints = {}, None, []
        try:
            if verb != "ROLLBACK":
                self._publish(staged, pinned)
        finally:
            self._clear()

    def _publish(self, staged: dict[str, DataFrame], pinned: dict[str, int]) -> None:
        """One commit over all tables that were changed: all of them or none."""
        txn = f"{self.root}/_txn/{uuid.uuid4().hex}" if len(staged) > 1 else None
        done: list[Table] = []
        try:
            for name, rows in sorted(staged.items()):
                t = self.table(name)
                m = t.manifest(pinned[name])
                old = t.read(m.version)
                names = [f"`{f}`" for f in StructType.fromDDL(m.schema).fieldNames()]
                gone = old.join(rows.select(m.key), m.key, "left_anti").select(*names).withColumn("_op", F.lit(DROP))
                same = old.withColumn("_row", F.struct(*names)).select(F.col(f"`{m.key}`").alias("_k"), "_row")
                put = rows.select(*names).join(same, (F.col(f"`{m.key}`") == F.col("_k")) & F.struct(*names).eqNullSafe(F.col("_row")), "left_anti").withColumn("_op", F.lit(KEEP))
                before = t.version
                if t.commit(gone.unionByName(put).withColumn("_seq", F.lit(0)), m.version, strict_noop=False, txn=txn) != before or txn:
                    done.append(t)
            if txn and done and done[0].decide(txn) != "commit":
                raise CommitError("the transaction was given up by another writer")
        except Exception:
            if txn and done:
                done[0].decide(txn, "abort")
            raise

    def _stored(self, rows: DataFrame) -> DataFrame:
        """Rows written and read again: what depends on an order or a partition must not be computed twice."""
        path = f"{self.root}/_stage/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        self._stage.append(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def _clear(self) -> None:
        for path in self._stage:
            self.files.delete(path)
        self._stage = []

    # Definitions.

    def _create(self, text: str) -> None:
        if re.match(r"CREATE\s+TRIGGER\b", text, re.I):
            trigger, m = Trigger.of(text), _TRIGGER.match(text.strip())
            t = self.table(m["table"])
            known = t.manifest().triggers
            if any(Trigger.of(x).name.lower() == trigger.name.lower() for x in known):
                if re.match(r"CREATE\s+TRIGGER\s+IF\s+NOT", text, re.I):
                    return
                raise InvalidChangeError(f"trigger {trigger.name} exists")
            t.set_triggers([*known, text])
            return
        if not (m := _CREATE.match(text)):
            if re.match(r"CREATE\s+(UNIQUE\s+)?INDEX\b", text, re.I):
                return  # files are pruned by bucket and statistics; an index changes no result
            raise InvalidChangeError("only tables, triggers and indexes can be created")
        if m["soft"] and m["table"] in self.tables():
            return
        fields, key, not_null, unique, defaults = [], None, [], [], {}
        for part in _parts(m["body"]):
            if whole := re.match(r"(PRIMARY\s+KEY|UNIQUE)\s*\(([^)]*)\)", part, re.I):
                columns = [c.strip() for c in whole[2].split(",")]
                if whole[1].upper() == "UNIQUE":
                    unique.append(columns)
                elif len(columns) == 1:
                    key = columns[0]
                else:
                    raise InvalidChangeError("a key has one column")
                continue
            name, *rest = part.split(None, 1)
            rest = rest[0] if rest else "TEXT"
            kind = rest.split()[0].upper()
            fields.append(f"{name} {_TYPES.get(kind, 'string')}")
            key = name if re.search(r"\bPRIMARY\s+KEY\b", rest, re.I) else key
            not_null += [name] if re.search(r"\bNOT\s+NULL\b", rest, re.I) else []
            unique += [[name]] if re.search(r"\bUNIQUE\b", rest, re.I) else []
            if d := re.search(r"\bDEFAULT\s+('(?:[^']|'')*'|\S+)", rest, re.I):
                defaults[name] = d[1]
        Table.create(self.spark, f"{self.root}/{m['table']}", ", ".join(fields), key or fields[0].split()[0], self.buckets, not_null, unique, defaults)

    def _drop(self, words: list[str]) -> None:
        what, soft, name = words[1], "EXISTS" in words, words[-1].strip('"`[]')
        if what == "TABLE":
            found = next((t for t in self.tables() if t.lower() == name.lower()), None)
            if found is None and not soft:
                raise NotFoundError(name)
            if found:
                self.files.delete(f"{self.root}/{found}")
        elif what == "TRIGGER":
            for t in self.tables():
                known = self.table(t).manifest().triggers
                left = [x for x in known if Trigger.of(x).name.lower() != name.lower()]
                if len(left) < len(known):
                    self.table(t).set_triggers(left)
                    return
            if not soft:
                raise NotFoundError(name)
        elif what != "INDEX":
            raise InvalidChangeError(f"cannot drop {what}")

    def _pragma(self, text: str) -> DataFrame:
        name = re.match(r"PRAGMA\s+(\w+)", text, re.I)[1].lower()
        of = re.search(r"\(\s*[\"`']?(\w+)", text)
        if name == "integrity_check":
            found = [x for t in self.tables() for x in self.table(t).integrity_check()] or ["ok"]
            return self.spark.createDataFrame([(x,) for x in found], "integrity_check string")
        if name == "wal_checkpoint":
            return self.spark.createDataFrame([(self.table(t).compact(),) for t in self.tables()], "version long")
        if name == "table_info" and of:
            m = self.table(of[1]).manifest()
            kinds = {"bigint": "INTEGER", "string": "TEXT", "binary": "BLOB", "double": "REAL"}
            rows = [(k, f.name, kinds.get(f.dataType.simpleString(), "TEXT"), int(f.name in m.not_null and f.name != m.key), m.defaults.get(f.name), int(f.name == m.key)) for k, f in enumerate(StructType.fromDDL(m.schema))]
            return self.spark.createDataFrame(rows, "cid long, name string, type string, notnull long, dflt_value string, pk long")
        if name == "journal_mode":
            return self.spark.createDataFrame([("wal",)], "journal_mode string")
        if name == "page_count":  # files that the newest versions name
            n = sum(len(m.folders) + sum(len(d["buckets"]) for d in m.deltas) for m in (self.table(t).manifest() for t in self.tables()))
            return self.spark.createDataFrame([(n,)], "page_count long")
        return self.spark.createDataFrame([], f"{name} string")  # settings of a page store have no counterpart

    # Changes.

    def _statement(self, verb: str, text: str, args: list | None) -> None:
        """One statement with its triggers: kept for the open transaction, or committed."""
        alone = self.pinned is None
        if alone:
            self.pinned, self.staged = {}, {}
        before = dict(self.staged)
        self._names = self.tables()
        try:
            n = self._change(verb, text, args)
            if alone:
                self._publish(self.staged, self.pinned)
            self.changes = n
            self.total_changes += n
        except Exception:
            self.staged = before
            raise
        finally:
            self._names = None
            if alone:
                self.staged, self.pinned = {}, None
                self._clear()

    def _change(self, verb: str, text: str, args: list | None = None, changed: DataFrame | None = None, depth: int = 0) -> int:
        """Stages one statement and what its triggers do; gives the rows changed. ``changed`` are the rows of the trigger that it
        belongs to."""
        if depth > DEPTH:
            raise InvalidChangeError("triggers fire one another without end")
        if verb == "REPLACE":
            verb, text = "INSERT", re.sub(r"^\s*REPLACE", "INSERT OR REPLACE", text, flags=re.I)
        parsed = {"INSERT": _ROWS, "UPDATE": _UPDATE, "DELETE": _DELETE}[verb].match(text.strip())
        if not parsed:
            raise InvalidChangeError(f"cannot read {text[:60]}")
        given = parsed["table"] if verb == "INSERT" else parsed[1]
        name = next((t for t in self.tables() if t.lower() == given.lower()), None)
        if name is None:
            raise NotFoundError(given)
        t = self.table(name)
        m = t.manifest(self.pinned.setdefault(name, t.version))
        old = self._current(name)
        if verb == "INSERT":
            pairs = self._inserted(parsed, m, name, old, args, changed)
        elif verb == "UPDATE":
            sets, where = _where(parsed[2])
            pairs = self._updated(m, name, old, _sets(sets), where, args, changed)
        else:
            pairs = self._deleted(m, name, old, parsed[2] or "1", args, changed)
        pairs = self._stored(pairs)
        n = pairs.count()
        if n:
            self._apply(verb, t, m, name, old, pairs, depth)
        return n

    def _apply(self, verb: str, t: Table, m: Manifest, name: str, old: DataFrame, pairs: DataFrame, depth: int) -> None:
        """Checks, stages and fires. pairs has new_ and old_ columns of each changed row, in order of _seq."""
        kinds = StructType.fromDDL(m.schema)
        fires = [Trigger.of(x) for x in reversed(m.triggers)]  # SQLite fires the last declared first
        inserts = pairs.where(f"`old_{m.key.lower()}` IS NULL")
        updates = pairs.where(f"`old_{m.key.lower()}` IS NOT NULL AND `new_{m.key.lower()}` IS NOT NULL")
        deletes = pairs.where(f"`new_{m.key.lower()}` IS NULL")
        groups = {"INSERT": [("INSERT", inserts), ("UPDATE", updates)], "UPDATE": [("UPDATE", pairs)], "DELETE": [("DELETE", deletes)]}[verb]
        groups = [(kind, rows) for kind, rows in groups if any(x.verb == kind for x in fires)]
        for kind, rows in groups:
            self._fire(fires, True, kind, rows, depth)
        old = self._current(name)  # as before-triggers left it
        if verb != "DELETE":
            new = pairs.select(*[F.col(f"`new_{f.name.lower()}`").cast(f.dataType).alias(f.name) for f in kinds])
            nulls = new.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in m.not_null]).first()
            if bad := [c for c in m.not_null if nulls[c]]:
                raise ConstraintError(f"{name}.{bad[0]} must not be null")
        gone = pairs.select(F.coalesce(F.col(f"`old_{m.key.lower()}`"), F.col(f"`new_{m.key.lower()}`")).cast(kinds[m.key].dataType).alias(m.key))
        left = old.join(gone, m.key, "left_anti").select(*[f"`{f}`" for f in kinds.fieldNames()])
        after = left if verb == "DELETE" else left.unionByName(new)
        if verb != "DELETE":
            for columns in m.unique:
                touched = after.dropna(subset=columns).join(new.select(*columns).dropna().distinct(), list(columns), "left_semi")
                if not touched.groupBy(*columns).count().where("count > 1").isEmpty():
                    raise ConstraintError(f"{', '.join(columns)} must be unique")
        self.staged[name] = after
        if verb == "INSERT" and kinds[m.key].dataType.simpleString() == "bigint":
            if depth == 0:
                self.last_insert_rowid = new.select(F.col(f"`{m.key}`").alias("_k"), F.monotonically_increasing_id().alias("_n")).agg(F.max_by("_k", "_n")).first()[0]
        for kind, rows in groups:
            self._fire(fires, False, kind, rows, depth)

    def _fire(self, triggers: list[Trigger], before: bool, kind: str, rows: DataFrame, depth: int) -> None:
        for x in triggers:
            if x.verb != kind or x.before != before:
                continue
            if x.columns:  # only rows that the statement sets those columns of
                same = F.lit(True)
                for c in x.columns:
                    same = same & F.col(f"`new_{c}`").eqNullSafe(F.col(f"`old_{c}`"))
                mine = rows.where(~same)
            else:
                mine = rows
            met = mine if x.test == "1" else self.query(f"SELECT _changed.* FROM _changed WHERE {_rows_of(x.test)}", views={"_changed": mine})
            if met.isEmpty():
                continue
            for body in x.body:
                verb = next(t.word for t in dialect.tokens(body) if t.kind != "space")
                if verb == "SELECT":
                    self._raise(_rows_of(body), met)
                else:
                    self._change(verb, _rows_of(body), None, met, depth + 1)

    def _raise(self, body: str, rows: DataFrame) -> None:
        """Runs a SELECT for its RAISE calls: each becomes a text that is looked for."""
        sign = "raise:" + uuid.uuid4().hex + ":"
        found = re.sub(r"\bRAISE\s*\(\s*(?:ABORT|FAIL|ROLLBACK)\s*,\s*'((?:[^']|'')*)'\s*\)", lambda m: f"'{sign}{m[1]}'", body, flags=re.I)
        if found == body:
            return
        select = re.sub(r"^\s*SELECT\b", "", found, flags=re.I)
        head, _, where = select.partition(" WHERE ") if not select.lstrip().upper().startswith("CASE") else (select, "", "")
        rows_sql = f"SELECT ({head.strip()}) AS said FROM _changed" + (f" WHERE {where}" if where else "")
        bad = self.query(rows_sql, views={"_changed": rows}).where(F.col("said").cast("string").startswith(sign)).first()
        if bad is not None:
            raise ConstraintError(bad.said[len(sign) :])

    def _pairs(self, df: DataFrame, m: Manifest, new: bool, old: bool) -> DataFrame:
        """df with the columns of both sides, null where there is none."""
        kinds = StructType.fromDDL(m.schema)
        have = set(df.columns)
        cols = [(F.col(f"`{side}_{f.name.lower()}`") if f"{side}_{f.name.lower()}" in have else F.lit(None)).cast(f.dataType).alias(f"{side}_{f.name.lower()}") for side in ("new", "old") for f in kinds]
        return df.select(*cols)

    def _updated(self, m: Manifest, name: str, old: DataFrame, sets: dict[str, str], where: str, args: list | None, changed: DataFrame | None) -> DataFrame:
        if m.key.lower() in sets:
            raise InvalidChangeError("a key cannot be updated; delete and insert")
        names = StructType.fromDDL(m.schema).fieldNames()
        own = {n.lower() for n in names}
        unknown = set(sets) - own
        if unknown:
            raise InvalidChangeError(f"no column {', '.join(sorted(unknown))}")
        if changed is None:  # values are bound in the order of the text: SET, then WHERE
            order = {n: k for k, n in enumerate(sets)}
            columns = [f"({sets[n]}) AS new_{n}" for n in sorted(sets, key=order.get)]
            columns += [f"`{n}` AS new_{n.lower()}" for n in names if n.lower() not in sets] + [f"`{n}` AS old_{n.lower()}" for n in names]
            return self._pairs(self.query(f"SELECT {', '.join(columns)} FROM {name} WHERE {where}", args), m, True, True)
        value = {n: _qualified(sets[n], own, name) if n in sets else f"{name}.`{n}`" for n in (x.lower() for x in names)}
        columns = [f"({value[n.lower()]}) AS new_{n.lower()}" for n in names] + [f"{name}.`{n}` AS old_{n.lower()}" for n in names]
        numbered = self._stored(changed.withColumn("_n", F.monotonically_increasing_id()))
        met = self.query(f"SELECT {', '.join(columns)}, _changed._n AS _n FROM {name} CROSS JOIN _changed WHERE {_qualified(where, own, name)}", views={"_changed": numbered})
        first = met.withColumn("_k", F.row_number().over(Window.partitionBy(f"old_{m.key.lower()}").orderBy("_n"))).where("_k = 1")
        return self._pairs(first, m, True, True)

    def _deleted(self, m: Manifest, name: str, old: DataFrame, where: str, args: list | None, changed: DataFrame | None) -> DataFrame:
        names = StructType.fromDDL(m.schema).fieldNames()
        columns = ", ".join(f"{name}.`{n}` AS old_{n.lower()}" for n in names)
        if changed is None:
            return self._pairs(self.query(f"SELECT {columns} FROM {name} WHERE {where}", args), m, False, True)
        met = self.query(f"SELECT {columns} FROM {name} CROSS JOIN _changed WHERE {_qualified(where, {n.lower() for n in names}, name)}", views={"_changed": changed})
        return self._pairs(met.dropDuplicates([f"old_{m.key.lower()}"]), m, False, True)

    def _inserted(self, parsed: re.Match, m: Manifest, name: str, old: DataFrame, args: list | None, changed: DataFrame | None) -> DataFrame:
        kinds = StructType.fromDDL(m.schema)
        given = [c.strip().strip('"`').lower() for c in parsed["columns"].split(",")] if parsed["columns"] else [f.lower() for f in kinds.fieldNames()]
        source = parsed["source"]
        if source.upper().startswith("DEFAULT"):
            source, given = "SELECT NULL", [m.key.lower()]
        if changed is not None:
            if source.upper().startswith("VALUES"):
                inner = source.strip()[6:].strip()
                source = f"SELECT {inner[1:-1]} FROM _changed"
            elif " FROM " not in source.upper():
                source = f"{source} FROM _changed"
            rows = self.query(source, args, {"_changed": changed}).toDF(*given)
        else:
            rows = self.query(source, args).toDF(*given)
        key = m.key.lower()
        cols = [(F.col(f"`{f.name.lower()}`") if f.name.lower() in given else F.expr(m.defaults.get(f.name, "NULL"))).cast(f.dataType).alias(f.name) for f in kinds]
        rows = rows.select(*cols)
        if kinds[m.key].dataType.simpleString() == "bigint" and (key not in given or not rows.where(F.col(f"`{m.key}`").isNull()).isEmpty()):
            rows = self._numbered(rows, m.key, old)
        if parsed["replace"]:
            seen = rows.withColumn("_n", F.monotonically_increasing_id()).groupBy(F.col(f"`{m.key}`").alias("_k")).agg(F.max_by(F.struct(*[f"`{f}`" for f in kinds.fieldNames()]), "_n").alias("_r")).select("_r.*")
            return self._pairs(seen.select(*[F.col(f"`{f}`").alias(f"new_{f.lower()}") for f in kinds.fieldNames()]), m, True, False)
        conflict = (parsed["conflict"] or "").upper()
        if conflict == "NOTHING" or parsed["ignore"]:
            rows = rows.join(old.select(m.key), m.key, "left_anti").dropDuplicates([m.key]).select(*[f"`{f}`" for f in kinds.fieldNames()])
        elif conflict:
            sets = _sets(re.sub(r"^UPDATE\s+SET\s+", "", _where(parsed["conflict"])[0], flags=re.I))
            own = {f.lower() for f in kinds.fieldNames()}
            value = {n: _qualified(sets[n], own, "_old") if n in sets else f"_old.`{n}`" for n in own}
            columns = [f"CASE WHEN _old.`{m.key}` IS NULL THEN excluded.`{f}` ELSE {value[f.lower()]} END AS new_{f.lower()}" for f in kinds.fieldNames()]
            columns += [f"_old.`{f}` AS old_{f.lower()}" for f in kinds.fieldNames()]
            both = self.query(f"SELECT {', '.join(columns)} FROM excluded LEFT JOIN _old ON excluded.`{m.key}` = _old.`{m.key}`", None, {"excluded": rows, "_old": old})
            if not rows.groupBy(F.col(f"`{m.key}`")).count().where("count > 1").isEmpty():
                raise ConstraintError(f"{m.key} twice in one upsert")
            return self._pairs(both, m, True, True)
        else:
            self.table(name).check_new(rows, old, m.key)
        return self._pairs(rows.select(*[F.col(f"`{f}`").alias(f"new_{f.lower()}") for f in kinds.fieldNames()]), m, True, False)

    def _numbered(self, rows: DataFrame, key: str, old: DataFrame) -> DataFrame:
        """Rows without a key numbered on from the largest: by counts of the partitions, so that no task holds them all."""
        top = old.agg(F.max(F.col(f"`{key}`"))).first()[0] or 0
        given = rows.agg(F.max(F.col(f"`{key}`"))).first()[0] or 0
        marked = self._stored(rows.withColumn("_at", F.monotonically_increasing_id()))  # the order is fixed once written
        lone = marked.where(F.col(f"`{key}`").isNull()).withColumn("_p", F.shiftright("_at", 33))
        counts = {r["_p"]: r["count"] for r in lone.groupBy("_p").count().collect()}  # a number for each partition
        first, at = {}, max(top, given)
        for p in sorted(counts):
            first[p], at = at, at + counts[p]
        starts = self.spark.createDataFrame(sorted(first.items()) or [(0, 0)], "_p long, _first long")
        nth = F.row_number().over(Window.partitionBy("_p").orderBy("_at"))
        whole = lone.join(F.broadcast(starts), "_p").withColumn(key, F.col("_first") + nth)
        return whole.select(*[f"`{c}`" for c in rows.columns]).unionByName(marked.where(F.col(f"`{key}`").isNotNull()).select(*[f"`{c}`" for c in rows.columns]))
