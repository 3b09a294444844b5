"""Pipeline specifications: JSON in, checked dictionaries out."""

from __future__ import annotations

import re

from ..errors import SpecError
from ..operators.blocks import IDENTIFIER

DEFAULTS = {"channel_capacity": 100, "partitions": 1, "quality_checks": [], "masking": [], "clean_blocks": [], "post_dbt_sinks": [], "depends_on": [], "dependency_mode": "any", "draft": False, "anomaly_alerts": False}
FIELDS = {"pipeline_id", "sources", "transform", "sinks", "embedding", "llm", "python", "visualization", "dbt", "schedule", "alerts", *DEFAULTS}


def _require(fine: bool, what: str) -> None:
    if not fine:
        raise SpecError(what)


def parse(spec: dict) -> dict:
    """The specification with defaults and node names; SpecError if it can't run."""
    _require(not (extra := set(spec) - FIELDS), f"unknown fields: {sorted(extra)}")
    out = {**DEFAULTS, **spec}
    _require(bool(re.fullmatch(r"[A-Za-z0-9_-]{1,128}", str(out.get("pipeline_id", "")))), "pipeline_id is missing or odd")
    if out["draft"]:
        return out
    for kind in ("sources", "sinks"):
        nodes = out.get(kind) or []
        _require(bool(nodes), f"{kind} are missing")
        out[kind] = [{"config": {}, **n, "name": n.get("name") or f"{kind[:-1]}{i}"} for i, n in enumerate(nodes)]
        for n in out[kind]:
            _require(bool(str(n.get("connector", "")).strip()), f"{n['name']} has no connector")
            _require(bool(IDENTIFIER.fullmatch(n["name"])), f"{n['name']!r} is no name")
            if kind == "sinks" and n["connector"] == "sqlite":
                _require(bool(n["config"].get("path")), "a sqlite sink needs a file")
    transform, python, blocks = out.get("transform"), out.get("python"), out["clean_blocks"]
    change_stream = any(n["connector"].endswith("-cdc") for n in out["sources"])
    if blocks:
        _require(not transform and not python, "clean_blocks exclude transform and python")
        _require(len(out["sources"]) == 1, "clean_blocks need one source")
        if change_stream:
            for b in blocks:
                _require(b["kind"] != "aggregate", "changes can't be aggregated")
                if b["kind"] == "select_columns":
                    _require(("__opcode" in b["columns"]) == (b["mode"] == "keep"), "the opcode column would be lost")
    if not transform and not blocks:
        _require(len(out["sources"]) == 1 and (bool(python) or len(out["sinks"]) == 1), "several inputs or outputs need a transform")
    if transform:
        _require(bool(str(transform.get("sql", "")).strip()), "the SQL is blank")
    for kind in ("python", "visualization"):
        if stage := out.get(kind):
            _require(bool(str(stage.get("script", "")).strip()), f"the {kind} script is blank")
            _require(stage.get("timeout_seconds", 60) > 0, "timeouts are positive")
    if e := out.get("embedding"):
        _require(bool(e.get("source_column")) and bool(e.get("output_column")), "embedding needs columns")
        _require(e.get("dimension", 0) > 0, "embedding needs a dimension")
        c = e.get("chunking") or {}
        _require(c.get("chunk_size", 1) > 0 and 0 <= c.get("similarity_threshold", 0.8) <= 1, "chunking is out of range")
    if m := out.get("llm"):
        _require(bool(m.get("prompt", {}).get("name")) and m["prompt"].get("version", 1) >= 1, "llm needs a prompt")
        _require(0 <= m.get("temperature", 0) <= 2 and m.get("cache", {}).get("ttl_seconds", 1) > 0, "llm is out of range")
    _require(out["channel_capacity"] > 0 and out["partitions"] > 0, "capacities are positive")
    masked = [m["column"] for m in out["masking"]]
    _require(len(masked) == len(set(masked)), "a column is masked twice")
    ups = [d["upstream_pipeline_id"] for d in out["depends_on"]]
    _require(len(ups) == len(set(ups)) and out["pipeline_id"] not in ups, "dependencies are doubled or circular")
    _require(not out["post_dbt_sinks"] or bool((out.get("dbt") or {}).get("output")), "post_dbt_sinks need dbt.output")
    if out.get("schedule"):
        _require(len(str(out["schedule"]).split()) in (5, 6), "a schedule has five or six fields")
    return out
