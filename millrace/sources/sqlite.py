"""SQLite files as a Spark data source: tasks read ranges of row numbers; a write is staged by tasks and applied in one transaction."""

from __future__ import annotations

import contextlib
import datetime
import decimal
import json
import os
import shutil
import sqlite3
import uuid

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage

from ..errors import SpecError
from .values import fitted, of_struct

OPCODE = "__opcode"
TYPES = {"bigint": "INTEGER", "int": "INTEGER", "smallint": "INTEGER", "tinyint": "INTEGER", "boolean": "INTEGER", "double": "REAL", "float": "REAL", "binary": "BLOB"}
COMPARED = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def quoted(name: str) -> str:
    if "\0" in name or not name:
        raise SpecError(f"{name!r} is no name")
    return '"' + name.replace('"', '""') + '"'


def declared(db, table: str) -> dict[str, str | None]:
    """Columns with the type their declaration gives, None where it gives none."""
    out = {}
    for _, name, kind, *_ in db.execute(f"PRAGMA table_info({quoted(table)})"):
        kind = (kind or "").upper()
        rules = (("INT", "bigint"), ("CHAR", "string"), ("CLOB", "string"), ("TEXT", "string"), ("BLOB", "binary"), ("REAL", "double"), ("FLOA", "double"), ("DOUB", "double"))
        out[name] = next((t for part, t in rules if part in kind), None)
    return out


def connect(path: str):
    if not os.path.exists(path):
        raise SpecError(f"no file {path}")
    return contextlib.closing(sqlite3.connect(f"file:{path}?mode=ro", uri=True))


def schema_of(path: str, table: str) -> str:
    """Columns as declared; where a declaration has no type, as the first values are."""
    with connect(path) as db:
        kinds = declared(db, table)
        if not kinds:
            raise SpecError(f"no table {table!r}")
        loose = [c for c, t in kinds.items() if t is None]
        for c in loose:
            seen = {r[0] for r in db.execute(f"SELECT DISTINCT typeof({quoted(c)}) FROM (SELECT {quoted(c)} FROM {quoted(table)} LIMIT 1000) WHERE {quoted(c)} IS NOT NULL")}
            kinds[c] = next((t for found, t in (({"integer"}, "bigint"), ({"integer", "real"}, "double"), ({"blob"}, "binary")) if seen and seen <= found), "string")
    return ", ".join(f"`{c}` {t}" for c, t in kinds.items())


class _Range(InputPartition):
    def __init__(self, low, high):
        self.low, self.high = low, high


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema):
        self.path, self.table, self.step = options["path"], options["table"], int(options.get("rows_per_task", 100_000))
        self.columns, self.where, self.given = of_struct(schema), [], []
        with connect(self.path) as db:
            self.kinds = declared(db, self.table)

    def pushFilters(self, filters):
        """Filters that SQLite sees alike leave rows in the file; Spark applies all of them again."""
        for f in filters:
            name = f.attribute[0]
            kind = self.kinds.get(name) if len(f.attribute) == 1 else None
            value = getattr(f, "value", None)
            plain = {"bigint": int, "double": float, "string": str}.get(kind)
            if plain and type(f) in COMPARED and type(value) is plain:
                self.where.append(f"{quoted(name)} {COMPARED[type(f)]} ?")
                self.given.append(value)
            elif plain and type(f) is In and value and all(type(v) is plain for v in value) and len(value) < 500:
                self.where.append(f"{quoted(name)} IN ({', '.join('?' * len(value))})")
                self.given += list(value)
            elif type(f) is IsNotNull and kind:
                self.where.append(f"{quoted(name)} IS NOT NULL")
            yield f

    def partitions(self):
        with connect(self.path) as db:
            try:
                low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(self.table)}").fetchone()
            except sqlite3.OperationalError:  # a view, or a table without row numbers
                return [_Range(None, None)]
        if low is None:  # no rows, or a view, whose row numbers are null
            return [_Range(None, None)]
        step = max(self.step, -(-(high - low + 1) // 10_000))
        return [_Range(a, min(a + step - 1, high)) for a in range(low, high + 1, step)]

    def read(self, partition):
        if partition is None:  # Spark's task for a table without rows
            return
        where, given = list(self.where), list(self.given)
        if partition.low is not None:
            where, given = ["rowid BETWEEN ? AND ?", *where], [partition.low, partition.high, *given]
        names = ", ".join(quoted(c) for c, _ in self.columns) or "1"
        with connect(self.path) as db:
            found = db.execute(f"SELECT {names} FROM {quoted(self.table)}" + (" WHERE " + " AND ".join(where) if where else ""), given)
            while rows := found.fetchmany(4096):
                for r in rows:
                    yield tuple(fitted(v, t) for v, (_, t) in zip(r, self.columns, strict=False)) if self.columns else ()


class _Staged(WriterCommitMessage):
    def __init__(self, file: str | None):
        self.file = file


def stored(value):
    """A value as SQLite keeps it: times and decimals as text, nested values as JSON."""
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    if isinstance(value, decimal.Decimal):
        return str(value)
    return json.dumps(value, default=str) if isinstance(value, (list, dict)) else value


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, schema, overwrite: bool):
        self.path, self.table, self.overwrite = options["path"], options["table"], overwrite
        self.keys = [k.strip() for k in options.get("primary_key", "").split(",") if k.strip()]
        self.columns = [(f.name, f.dataType.simpleString()) for f in schema.fields if f.name != OPCODE]
        self.codes = OPCODE in schema.fieldNames()
        if missing := [k for k in self.keys if k not in dict(self.columns)]:
            raise SpecError(f"no column {missing[0]!r}")
        if self.codes and not self.keys:
            raise SpecError("changes need a primary_key")
        self.folder = os.path.join(options["staging"], f"sqlite-{uuid.uuid4().hex}")
        os.makedirs(self.folder, exist_ok=True)

    def write(self, iterator):
        file, out = os.path.join(self.folder, f"{uuid.uuid4().hex}.arrow"), None
        for batch in iterator:
            if self.codes and (bad := set(batch.column(batch.schema.get_field_index(OPCODE)).to_pylist()) - {"I", "U", "D"}):
                raise ValueError(f"bad opcode: {bad.pop() or 'null'}")
            out = out or pa.ipc.new_file(file, batch.schema)
            out.write_batch(batch)
        if out is None:
            return _Staged(None)
        out.close()
        return _Staged(file)

    def commit(self, messages):
        """Applies what tasks have staged in one transaction: upserts, then deletes.  A second run of the same job leaves the same table."""
        names = [c for c, _ in self.columns]
        with contextlib.closing(sqlite3.connect(self.path, isolation_level=None)) as db:
            db.execute("BEGIN IMMEDIATE")
            try:
                key = f", PRIMARY KEY ({', '.join(map(quoted, self.keys))})" if self.keys else ""
                made = ", ".join(f"{quoted(c)} {TYPES.get(t, 'TEXT')}" for c, t in self.columns)
                db.execute(f"CREATE TABLE IF NOT EXISTS {quoted(self.table)} ({made}{key})")
                if self.overwrite:
                    db.execute(f"DELETE FROM {quoted(self.table)}")
                sql = f"INSERT INTO {quoted(self.table)} ({', '.join(map(quoted, names))}) VALUES ({', '.join('?' * len(names))})"
                if self.keys:
                    rest = [c for c in names if c not in self.keys]
                    change = "UPDATE SET " + ", ".join(f"{quoted(c)} = excluded.{quoted(c)}" for c in rest) if rest else "NOTHING"
                    sql += f" ON CONFLICT ({', '.join(map(quoted, self.keys))}) DO {change}"
                gone = f"DELETE FROM {quoted(self.table)} WHERE " + " AND ".join(f"{quoted(k)} IS ?" for k in self.keys)
                for deletes in (False, True) if self.codes else (False,):
                    for batch in self._batches(messages):
                        codes = batch.column(OPCODE).to_pylist() if self.codes else ["I"] * batch.num_rows
                        mine = self.keys if deletes else names
                        rows = zip(*(batch.column(c).to_pylist() for c in mine), strict=True)
                        db.executemany(gone if deletes else sql, [tuple(map(stored, r)) for r, code in zip(rows, codes, strict=True) if (code == "D") == deletes])
                db.execute("COMMIT")
            except BaseException:
                db.execute("ROLLBACK")
                raise
        shutil.rmtree(self.folder, ignore_errors=True)

    @staticmethod
    def _batches(messages):
        for m in messages:
            if m is not None and m.file:
                with pa.OSFile(m.file) as f:
                    held = pa.ipc.open_file(f)
                    for k in range(held.num_record_batches):
                        yield held.get_batch(k)

    def abort(self, messages):
        shutil.rmtree(self.folder, ignore_errors=True)


class SqliteSource(DataSource):
    """Options: path, table; to read, rows_per_task; to write, primary_key (names with commas) and staging, a folder that all tasks share."""

    @classmethod
    def name(cls):
        return "millrace_sqlite"

    def schema(self):
        return schema_of(self.options["path"], self.options["table"])

    def reader(self, schema):
        return _Reader(self.options, schema)

    def writer(self, schema, overwrite):
        return _Writer(self.options, schema, overwrite)
