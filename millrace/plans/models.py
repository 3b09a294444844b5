"""SQL models that refer to each other: run in the order of their references, tested when they are there."""

from __future__ import annotations

import json
import re
from graphlib import CycleError, TopologicalSorter
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ModelError, SpecError
from ..operators import quality, sqlstage
from ..operators.blocks import IDENTIFIER

REF = re.compile(r"\{\{\s*ref\(\s*['\"](\w+)['\"]\s*\)\s*\}\}")
SOURCE = re.compile(r"\{\{\s*source\(\s*['\"]\w+['\"]\s*,\s*['\"](\w+)['\"]\s*\)\s*\}\}")
COMMANDS = ("run", "build", "test")


def load(folder: str) -> tuple[dict[str, str], list[dict]]:
    """Models (name, SQL) and their tests from ``models/**/*.sql`` and the ``.json`` or ``.yml`` files beside them.

    Tests are written as ``{"models": [{"name", "columns": [{"name", "tests": [...]}]}]}``.
    """
    at = Path(folder) / "models"
    models, tests = {}, []
    for file in sorted(at.rglob("*.sql")):
        if file.stem in models:
            raise SpecError(f"two models {file.stem!r}")
        models[file.stem] = file.read_text(encoding="utf-8")
    if not models:
        raise SpecError(f"no models in {at}")
    for file in sorted([*at.rglob("*.json"), *at.rglob("*.yml"), *at.rglob("*.yaml")]):
        text = file.read_text(encoding="utf-8")
        if file.suffix == ".json":
            about = json.loads(text)
        else:
            import yaml  # only projects with such files need it

            about = yaml.safe_load(text) or {}
        for m in about.get("models", []):
            for c in m.get("columns", []):
                tests += [{"model": m["name"], "column": c["name"], "test": t} for t in c.get("tests", [])]
    return models, tests


def order(models: dict[str, str]) -> list[str]:
    """Names so that each comes after those it refers to; unknown references and cycles raise SpecError."""
    graph = {}
    for name, sql in models.items():
        if not IDENTIFIER.fullmatch(name):
            raise SpecError(f"{name!r} is no name")
        graph[name] = set(REF.findall(sql))
        if unknown := graph[name] - set(models):
            raise SpecError(f"{name} refers to {sorted(unknown)[0]!r}, which is no model")
    try:
        return list(TopologicalSorter(graph).static_order())
    except CycleError as e:
        raise SpecError(f"models refer to each other: {' > '.join(e.args[1])}") from e


def needed(models: dict[str, str], wanted: list[str]) -> dict[str, str]:
    """``wanted`` models and those they are made of."""
    out, left = {}, list(wanted)
    while left:
        name = left.pop()
        if name not in models:
            raise SpecError(f"no model {name!r}")
        if name not in out:
            out[name] = models[name]
            left += REF.findall(models[name])
    return out


def build(models: dict[str, str], inputs: dict[str, DataFrame], path: str | None = None) -> dict[str, DataFrame]:
    """Each model as a DataFrame over ``inputs`` and the models it refers to; with ``path`` a Parquet table below it, computed once."""
    if both := set(models) & set(inputs):
        raise SpecError(f"{sorted(both)[0]!r} is a model and an input")
    made: dict[str, DataFrame] = {}
    for name in order(models):
        sql = SOURCE.sub(r"`\1`", REF.sub(r"`\1`", models[name]))
        df = sqlstage.transform({**inputs, **{k: made[k] for k in REF.findall(models[name])}}, sql.strip().rstrip(";"))
        if path:
            df.write.mode("overwrite").parquet(f"{path}/{name}")
            df = df.sparkSession.read.schema(df.schema).parquet(f"{path}/{name}")
        made[name] = df
    return made


def _check(test) -> dict | None:
    if isinstance(test, str):
        return {"kind": test} if test in ("not_null", "unique") else None
    (kind, given), *_ = test.items()
    return {"kind": "accepted_values", "values": given["values"]} if kind == "accepted_values" else None


def test(made: dict[str, DataFrame], tests: list[dict]) -> list[dict]:
    """model, column, test, status (pass or fail), failures of every test on a model that was made: not_null, unique, accepted_values and relationships."""
    out = []
    for name, df in made.items():
        mine = [t for t in tests if t["model"] == name]
        plain = [(t, c) for t in mine if (c := _check(t["test"]))]
        if plain:
            found = quality.run_checks(df, [{"column": t["column"], "check": c} for t, c in plain], examples=False).collect()
            out += [{"model": name, "column": r.column, "test": r.check, "status": r.status, "failures": r.violation_count} for r in found]
        for t in mine:
            if _check(t["test"]):
                continue
            if not isinstance(t["test"], dict) or "relationships" not in t["test"]:
                raise SpecError(f"no test {t['test']!r}")
            to = t["test"]["relationships"]
            other = (REF.search("{{" + str(to["to"]) + "}}") or re.match(r"(\w+)", str(to["to"]))).group(1)
            if other not in made:
                raise SpecError(f"no model {other!r}")
            mine_column = F.col(t["column"]).alias("__v")
            lost = df.filter(F.col(t["column"]).isNotNull()).select(mine_column).join(made[other].select(F.col(to["field"]).alias("__v")).distinct(), "__v", "left_anti").count()
            out.append({"model": name, "column": t["column"], "test": "relationships", "status": "fail" if lost else "pass", "failures": lost})
    return out


def run(project: str | dict, inputs: dict[str, DataFrame], command: str = "run", select: list[str] | str | None = None, path: str | None = None, tests: list[dict] | None = None) -> dict:
    """Models made from ``inputs`` and, for ``build`` and ``test``, the results of their tests; a failing test raises ModelError.

    ``project`` is a folder (see ``load``) or models by name.  ``select`` names models; what they refer to is made too.
    """
    if command not in COMMANDS:
        raise SpecError(f"no command {command!r}")
    models, found = (project, []) if isinstance(project, dict) else load(project)
    if select:
        models = needed(models, select.split() if isinstance(select, str) else select)
    made = build(models, inputs, path)
    results = test(made, found if tests is None else tests) if command != "run" else []
    if bad := [r for r in results if r["status"] == "fail"]:
        raise ModelError("; ".join(f"{r['model']}.{r['column']} {r['test']}: {r['failures']}" for r in bad), results)
    return {"models": made, "tests": results}
