"""Values of row-wise services as columns."""

from __future__ import annotations

import json

from ..errors import SpecError


def infer(rows: list[dict]) -> str:
    """Schema of rows: keys as first seen, typed by their first value that isn't null; nested values are text."""
    kinds: dict[str, str | None] = {}
    for row in rows:
        for k, v in row.items():
            if kinds.get(k) is None:
                kinds[k] = None if v is None else "boolean" if isinstance(v, bool) else "bigint" if isinstance(v, int) else "double" if isinstance(v, float) else "binary" if isinstance(v, bytes) else "string"
    return ", ".join(f"`{k}` {t or 'string'}" for k, t in kinds.items())


def fitted(value, kind: str):
    """``value`` as its column has it: null if it doesn't fit; text columns take anything, nested values as JSON."""
    if value is None:
        return None
    if kind == "binary":
        return value if isinstance(value, bytes) else value.encode() if isinstance(value, str) else None
    if kind == "string":
        if isinstance(value, bytes):
            return value.decode(errors="replace")
        return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, separators=(",", ":"))
    if kind == "boolean":
        return value if isinstance(value, bool) else None
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return None
    return float(value) if kind == "double" else value if isinstance(value, int) else None


def fields(schema: str) -> list[tuple[str, str]]:
    """Names and types of a schema that ``infer`` has written."""
    found = [(n.strip("`"), t) for n, t in (f.rsplit(" ", 1) for f in schema.split(", "))] if schema else []
    if bad := [t for _, t in found if t not in ("bigint", "double", "boolean", "string", "binary")]:
        raise SpecError(f"no type for JSON: {bad[0]}")
    return found


def of_struct(schema) -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in schema.fields]
