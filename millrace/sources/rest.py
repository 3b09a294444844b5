"""Paginated JSON services as a Spark data source: tables of pages that tasks fetch, and streams with an offset."""

from __future__ import annotations

import json
from urllib.parse import urlencode
from urllib.request import urlopen

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, InputPartition, SimpleDataSourceStreamReader

from ..errors import SpecError
from .retry import retried
from .values import fitted, infer, of_struct


def get(url: str, ask: dict, seconds: float = 30, retries: int = 3, backoff: float = 1.0):
    """The JSON that a service answers; passing errors are tried again."""

    def once():
        with urlopen(url + ("?" + urlencode(ask) if ask else ""), timeout=seconds) as reply:
            return json.load(reply)

    return retried(once, retries, backoff)


def dig(x, path: str | None):
    """What stands below names with dots between them; None if anything is missing."""
    for part in [p for p in (path or "").split(".") if p]:
        x = x.get(part) if isinstance(x, dict) else None
    return x


class _Service:
    """Options: url, rows_path, total_path, page_size, offset_param, limit_param, timeout_seconds, retries, retry_backoff_seconds, filters (names that the service takes as parameters)."""

    def __init__(self, options: dict):
        self.options = dict(options)
        self.size = int(options.get("page_size", 100))
        self.asked: dict[str, str] = {}

    def body(self, offset: int, limit: int):
        o = self.options
        ask = {o.get("offset_param", "offset"): offset, o.get("limit_param", "limit"): limit, **self.asked}
        return get(o["url"], ask, float(o.get("timeout_seconds", 30)), int(o.get("retries", 3)), float(o.get("retry_backoff_seconds", 1)))

    def rows(self, offset: int, limit: int) -> list[dict]:
        return dig(self.body(offset, limit), self.options.get("rows_path")) or []

    def total(self) -> int:
        found = dig(self.body(0, 1), self.options.get("total_path"))
        if found is None:
            raise SpecError("total_path doesn't lead to a number of rows")
        return int(found)


class _Pages(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema):
        self.service, self.columns = _Service(options), of_struct(schema)
        self.taken = {c.strip() for c in options.get("filters", "").split(",") if c.strip()}
        self.tasks = int(options.get("tasks", 64))

    def pushFilters(self, filters):
        """Equalities on columns that the service can filter by go into its parameters; Spark applies all filters again."""
        for f in filters:
            if type(f) is EqualTo and len(f.attribute) == 1 and f.attribute[0] in self.taken and f.attribute[0] not in self.service.asked:
                self.service.asked[f.attribute[0]] = str(f.value).lower() if isinstance(f.value, bool) else str(f.value)
            yield f

    def partitions(self):
        pages = -(-self.service.total() // self.service.size)
        each = max(1, -(-pages // self.tasks))
        return [_Pages(a, min(a + each, pages)) for a in range(0, pages, each)]

    def read(self, partition):
        if partition is None:  # Spark's task for a service without rows
            return
        for page in range(partition.first, partition.last):
            for r in self.service.rows(page * self.service.size, self.service.size):
                yield tuple(fitted(r.get(n), t) for n, t in self.columns)


class _Stream(SimpleDataSourceStreamReader):
    """A service whose rows keep their places: the offset is the number of rows read; ``rows_per_batch`` bounds a batch."""

    def __init__(self, options: dict, schema):
        self.service, self.columns = _Service(options), of_struct(schema)
        self.most = int(options.get("rows_per_batch", 10_000))

    def initialOffset(self):
        return {"row": 0}

    def _between(self, start: int, end: int):
        at = start
        while at < end:
            found = self.service.rows(at, min(self.service.size, end - at))
            if not found:
                return
            for r in found[: end - at]:
                yield tuple(fitted(r.get(n), t) for n, t in self.columns)
            at += len(found)

    def read(self, start):
        found = list(self._between(start["row"], start["row"] + self.most))
        return iter(found), {"row": start["row"] + len(found)}

    def readBetweenOffsets(self, start, end):
        return self._between(start["row"], end["row"])


class RestSource(DataSource):
    """Rows of a JSON service by offset; the schema is what its first page shows unless given."""

    @classmethod
    def name(cls):
        return "millrace_rest"

    def schema(self):
        service = _Service(self.options)
        found = infer(service.rows(0, service.size))
        if not found:
            raise SpecError("the service has no rows; give a schema")
        return found

    def reader(self, schema):
        return _Reader(self.options, schema)

    def simpleStreamReader(self, schema):
        return _Stream(self.options, schema)
