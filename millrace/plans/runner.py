"""Runs a pipeline specification as one lazy plan: masking, embedding, model calls, SQL or blocks, a script, checks, then the sinks."""

from __future__ import annotations

import time
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from ..errors import SinkError, SpecError
from ..operators import blocks, masking, quality, sqlstage, textstages
from ..session import scratch
from ..sources import registry
from ..sources.retry import retried
from . import models
from . import spec as specs

#: Stages of a specification that need more than Spark.
ELSEWHERE = ("visualization",)
LEDGER = "pipeline string, sink string, status string, rows long, bytes long, seconds double, error string"
#: Sinks that are written at the same time.
ABREAST = 8


def plan(spark: SparkSession, spec: dict, salt: str | None = None, embedder=textstages.hash_embed, prompts: dict[str, str] | None = None, backend=None) -> DataFrame:
    """The output of a checked specification, not yet computed.

    ``prompts`` has the templates that an ``llm`` stage names, ``backend`` answers lists of prompts.  A stage that can't run here raises.
    """
    if found := [k for k in ELSEWHERE if spec.get(k)]:
        raise SpecError(f"{found[0]} isn't run here")
    inputs = {n["name"]: registry.read(spark, n["connector"], n["config"]) for n in spec["sources"]}
    if spec["masking"]:
        inputs = {k: masking.mask(v, [m["column"] for m in spec["masking"]], salt) for k, v in inputs.items()}
    if e := spec.get("embedding"):
        c = e.get("chunking") or {}
        for k, v in inputs.items():
            if c.get("strategy") == "semantic":
                v = textstages.semantic_chunks(v, e["source_column"], e["dimension"], c.get("similarity_threshold", 0.8), embedder).drop("chunk_index")
            elif c:
                v = textstages.chunk(v, e["source_column"], c.get("strategy", "fixed_window"), c.get("chunk_size", 512), c.get("overlap", 0), c.get("separators")).drop("chunk_index")
            inputs[k] = textstages.embed(v, e["source_column"], e["output_column"], e["dimension"], embedder)
    if m := spec.get("llm"):
        name = m["prompt"]["name"]
        if backend is None or name not in (prompts or {}):
            raise SpecError(f"llm needs a backend and the prompt {name!r}")
        cache = m.get("cache") or {}
        options = {"model": (m.get("model") or {}).get("name", "local"), "max_tokens": m.get("max_tokens", 256), "temperature": m.get("temperature", 0.0), "cache": cache.get("url"), "ttl_seconds": cache.get("ttl_seconds")}
        inputs = {k: textstages.complete(v, prompts[name], m["input_columns"], m["output_column"], backend, **options) for k, v in inputs.items()}
    if spec.get("transform"):
        df = sqlstage.transform(inputs, spec["transform"]["sql"])
    else:
        df = next(iter(inputs.values()))
        df = blocks.chain(df, spec["clean_blocks"]) if spec["clean_blocks"] else df
    if p := spec.get("python"):
        df = textstages.with_script(df, p["script"], p.get("schema"))
    return df


def _finished(spark: SparkSession, ledger: str, pipeline: str) -> set[str]:
    """Sinks that a run before has written."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(ledger)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return set()
    held = spark.read.schema(LEDGER).parquet(ledger).filter((F.col("pipeline") == pipeline) & F.coalesce(F.col("status") == "written", F.lit(True)))
    return {r.sink for r in held.select("sink").distinct().collect()}


def _bytes(df: DataFrame):
    """Bytes of a row's values, about: those of texts and binaries, and of others as wide as their type."""
    size = F.lit(0)
    for f in df.schema:
        kind = f.dataType.typeName()
        if kind in ("string", "binary", "varchar", "char"):
            one = F.octet_length(F.col(f"`{f.name}`"))
        elif kind in ("array", "map", "struct", "variant"):
            one = F.octet_length(F.col(f"`{f.name}`").cast("string"))
        else:
            one = F.lit({"boolean": 1, "byte": 1, "short": 2, "integer": 4, "date": 4, "float": 4}.get(kind, 8))
        size = size + F.coalesce(one, F.lit(0))
    return F.coalesce(F.sum(size), F.lit(0))


def fan_out(df: DataFrame, sinks: list[dict]) -> dict[str, dict]:
    """Writes ``df`` to all sinks side by side, each in a scheduler pool of its own; a sink that fails stops no other.

    Per sink: status (written or failed), rows and bytes (None where Spark doesn't see them, as with a webhook), seconds, error.  A sink's config may
    have ``retries`` and ``retry_backoff_seconds``: passing errors are tried again.
    """
    context = df.sparkSession.sparkContext

    def write(sink: dict) -> dict:
        began, config, seen = time.time(), sink["config"], None
        context.setLocalProperty("spark.scheduler.pool", sink["name"])
        counted = sink["connector"] != "webhook"

        def once():
            nonlocal seen
            seen = Observation()
            rows = df.observe(seen, F.count(F.lit(1)).alias("rows"), _bytes(df).alias("bytes")) if counted else df
            registry.write(rows, sink["connector"], {k: v for k, v in config.items() if k not in ("retries", "retry_backoff_seconds")})

        out = {"status": "written", "rows": None, "bytes": None, "error": None}
        try:
            retried(once, config.get("retries", 3), config.get("retry_backoff_seconds", 1))
            if counted:
                out |= {k: seen.get[k] for k in ("rows", "bytes")}
        except Exception as e:
            out |= {"status": "failed", "error": f"{type(e).__name__}: {e}"[:2000]}
        return out | {"seconds": time.time() - began}

    with ThreadPoolExecutor(max(1, min(ABREAST, len(sinks)))) as pool:
        jobs = {s["name"]: pool.submit(inheritable_thread_target(df.sparkSession)(write), s) for s in sinks}
        return {name: job.result() for name, job in jobs.items()}


def _written(spark: SparkSession, pipeline: str, df: DataFrame, sinks: list[dict], ledger: str | None) -> dict[str, dict]:
    found = fan_out(df, sinks)
    if ledger and found:
        rows = [(pipeline, name, r["status"], r["rows"], r["bytes"], r["seconds"], r["error"]) for name, r in found.items()]
        spark.createDataFrame(rows, LEDGER).coalesce(1).write.mode("append").parquet(ledger)
    return found


def run(spark: SparkSession, spec: dict, salt: str | None = None, ledger: str | None = None, **stages) -> dict:
    """Runs ``spec`` and returns its checks, what was written to each sink, and rows, bytes and seconds of the run; ``stages`` are what ``plan`` takes.

    Sinks are written side by side from one computation, kept in executors' memory and disks.  If some fail the others are written none the less, and
    SinkError, which has the result, is raised at the end.  ``ledger`` is a folder that remembers each sink's outcome: a second run writes
    only to those that aren't finished.  ``dbt`` runs SQL models (see ``models``) over the sources and the output, named as the sinks are, when all
    sinks are written; ``post_dbt_sinks`` get the model that ``dbt.output`` names.
    """
    spec = specs.parse(spec)
    name, after = spec["pipeline_id"], [{"config": {}, **s, "name": s.get("name") or f"post_dbt_sink{k}"} for k, s in enumerate(spec["post_dbt_sinks"])]
    done = _finished(spark, ledger, name) if ledger else set()
    todo, later = [s for s in spec["sinks"] if s["name"] not in done], [s for s in after if s["name"] not in done]
    result = {"written": [], "failed": {}, "sinks": {}, "checks": None, "rows": 0, "bytes": 0, "seconds": 0.0, "tests": []}
    if not todo and not later and not (spec.get("dbt") and not ledger):
        return result
    if spec.get("dbt"):
        models.order(models.load(spec["dbt"]["project_dir"])[0])  # raises before anything is written
    df, began = plan(spark, spec, salt, **stages), time.time()
    many = len(todo) > 1 or bool(spec["quality_checks"]) or bool(spec.get("dbt"))
    df = df.persist() if many else df
    try:
        if spec["quality_checks"]:
            result["checks"] = quality.run_checks(df, spec["quality_checks"])
        result["sinks"] |= _written(spark, name, df, todo, ledger)
        failed = any(r["status"] == "failed" for r in result["sinks"].values())
        if (d := spec.get("dbt")) and not failed:
            inputs = {n["name"]: registry.read(spark, n["connector"], n["config"]) for n in spec["sources"]} | {s["name"]: df for s in spec["sinks"]}
            made = models.run(d["project_dir"], inputs, d.get("command", "run"), d.get("select"), scratch(spark, "models"))
            result["tests"] = made["tests"]
            if later:
                wanted = d["output"] if isinstance(d["output"], str) else d["output"].get("model") or d["output"].get("name")
                if wanted not in made["models"]:
                    raise SpecError(f"no model {wanted!r}")
                result["sinks"] |= _written(spark, name, made["models"][wanted], later, ledger)
    finally:
        if many:
            df.unpersist()
    counted = [r for r in result["sinks"].values() if r["rows"] is not None]
    result |= {"written": [k for k, r in result["sinks"].items() if r["status"] == "written"], "failed": {k: r["error"] for k, r in result["sinks"].items() if r["status"] == "failed"}}
    result |= {"rows": counted[0]["rows"] if counted else None, "bytes": counted[0]["bytes"] if counted else None, "seconds": time.time() - began}
    if result["failed"]:
        raise SinkError(result)
    return result
