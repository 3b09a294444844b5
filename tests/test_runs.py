"""Fan-out with an error per sink, SQL models, coercion of change events, inverted lists, running totals."""


import numpy as np
import oracle
import pytest
from pyspark.sql import functions as F

from millrace import catalog
from millrace.errors import ModelError, SinkError, SpecError
from millrace.functions import vectors
from millrace.operators import cdc, keyed
from millrace.plans import models, runner
from millrace.sources import registry
from millrace.streaming import streams, totals


def spec_of(tmp_path, **more):
    (tmp_path / "in.csv").write_text("code,who,score\n10,Ada,3\n11,Bo,18\n12,Cy,44\n")
    return {"pipeline_id": "p1", "sources": [{"connector": "csv", "config": {"path": str(tmp_path / "in.csv")}}], **more}


def test_a_failing_sink(spark, tmp_path):
    """One of three sinks fails: two are written, the ledger says so, and a second run writes the third only."""
    (tmp_path / "file").write_text("in the way")
    sink = lambda name: {"name": name, "connector": "parquet", "config": {"path": str(tmp_path / name), "retries": 0}}
    bad = {"name": "bad", "connector": "parquet", "config": {"path": str(tmp_path / "file" / "below"), "retries": 0}}
    p = spec_of(tmp_path, sinks=[sink("a"), bad, sink("b")], transform={"sql": "SELECT who, score * 2 AS twice FROM source0"})
    ledger = str(tmp_path / "ledger")
    with pytest.raises(SinkError, match="bad") as e:
        runner.run(spark, p, ledger=ledger)
    result = e.value.result
    assert result["written"] == ["a", "b"] and list(result["failed"]) == ["bad"] and result["rows"] == 3
    assert result["sinks"]["a"]["rows"] == result["sinks"]["b"]["rows"] == 3 and result["sinks"]["a"]["bytes"] == 3 * 8 + len("AdaBoCy")
    told = {r.sink: (r.status, r.rows, bool(r.error)) for r in spark.read.parquet(ledger).collect()}
    assert told == {"a": ("written", 3, False), "b": ("written", 3, False), "bad": ("failed", None, True)}
    before = {f.name for f in (tmp_path / "a").iterdir()}
    (tmp_path / "file").unlink()
    assert runner.run(spark, p, ledger=ledger)["written"] == ["bad"]
    assert {f.name for f in (tmp_path / "a").iterdir()} == before
    assert runner.run(spark, p, ledger=ledger)["written"] == []


def test_passing_errors_of_a_sink(spark, tmp_path, monkeypatch):
    calls, write = [], registry.write

    def fails_twice(df, connector, config):
        calls.append(config)
        if len(calls) < 3:
            raise OSError("connection reset by peer")
        write(df, connector, config)

    monkeypatch.setattr(registry, "write", fails_twice)
    p = spec_of(tmp_path, sinks=[{"connector": "json", "config": {"path": str(tmp_path / "out"), "retry_backoff_seconds": 0.01}}])
    assert runner.run(spark, p)["rows"] == 3 and len(calls) == 3 and "retries" not in calls[0]


# Models.
MODELS = {
    "top": "SELECT who, score FROM {{ ref('clean') }} WHERE score > (SELECT avg(score) FROM {{ ref('clean') }});",
    "clean": "SELECT upper(who) AS who, score FROM {{ source('raw', 'people') }}",
    "counted": "SELECT count(*) AS n FROM {{ ref('top') }} JOIN {{ ref('clean') }} USING (who)",
}


def test_models(spark, tmp_path):
    people = spark.createDataFrame([("ada", 3), ("bo", 18), ("cy", 44)], "who string, score long")
    assert models.order(MODELS) == ["clean", "top", "counted"]
    made = models.run(MODELS, {"people": people}, path=str(tmp_path / "m"))["models"]
    assert [r.who for r in made["top"].collect()] == ["CY"] and made["counted"].first().n == 1
    assert spark.read.parquet(str(tmp_path / "m" / "clean")).count() == 3
    assert set(models.run(MODELS, {"people": people}, select="top")["models"]) == {"top", "clean"}
    tests = [{"model": "clean", "column": "who", "test": t} for t in ("unique", "not_null", {"accepted_values": {"values": ["ADA", "BO", "CY"]}})]
    tests.append({"model": "top", "column": "who", "test": {"relationships": {"to": "ref('clean')", "field": "who"}}})
    assert [t["status"] for t in models.run(MODELS, {"people": people}, "build", tests=tests)["tests"]] == ["pass"] * 4
    with pytest.raises(ModelError, match="clean.who accepted_values: 1") as e:
        models.run(MODELS, {"people": people}, "test", tests=[*tests, {"model": "clean", "column": "who", "test": {"accepted_values": {"values": ["ADA", "CY"]}}}])
    assert [r["status"] for r in e.value.result].count("fail") == 1
    for bad, why in (({"a": "SELECT * FROM {{ ref('b') }}", "b": "SELECT * FROM {{ ref('a') }}"}, "each other"), ({"a": "SELECT * FROM {{ ref('z') }}"}, "no model"), ({"a-b": "SELECT 1"}, "no name")):
        with pytest.raises(SpecError, match=why):
            models.order(bad)


def test_models_of_a_pipeline(spark, tmp_path):
    """A specification with dbt: models over what was loaded, tests, and a sink that gets a model's rows."""
    at = tmp_path / "project" / "models"
    at.mkdir(parents=True)
    (at / "clean.sql").write_text("SELECT upper(who) AS who, score FROM {{ source('raw', 'sink0') }}")
    (at / "top.sql").write_text("SELECT who FROM {{ ref('clean') }} WHERE score > 10")
    (at / "last.sql").write_text("SELECT max(who) AS who FROM {{ ref('top') }}")
    (at / "tests.json").write_text('{"models": [{"name": "top", "columns": [{"name": "who", "tests": ["unique"]}]}]}')
    p = spec_of(tmp_path, sinks=[{"connector": "csv", "config": {"path": str(tmp_path / "out")}}], dbt={"project_dir": str(tmp_path / "project"), "command": "build", "output": {"model": "last"}},
                post_dbt_sinks=[{"name": "after", "connector": "json", "config": {"path": str(tmp_path / "after")}}])
    done = runner.run(spark, p)
    assert done["written"] == ["sink0", "after"] and [t["status"] for t in done["tests"]] == ["pass"]
    assert [r.who for r in spark.read.json(str(tmp_path / "after")).collect()] == ["CY"]
    (at / "tests.json").write_text('{"models": [{"name": "clean", "columns": [{"name": "who", "tests": [{"accepted_values": {"values": ["BO"]}}]}]}]}')
    with pytest.raises(ModelError):
        runner.run(spark, p)


# Change events.
def test_coercion(spark, tmp_path):
    rows = [("1", "t", "2.5", "x", "2024-02-03"), (" 2 ", "FALSE", "no", None, "soon"), ("three", "maybe", None, "y", None), (None, "f", "1e3", "z", "2024-02-30")]
    df, seen = cdc.coerced(spark.createDataFrame(rows, "id string, on string, x string, name string, day string"), {"id": "bigint", "on": "boolean", "x": "double", "name": "string", "day": "date", "late": "timestamp"})
    df.write.parquet(str(tmp_path / "t"))
    found = [(r.id, r.on, r.x, r.name, str(r.day) if r.day else None, r.late) for r in spark.read.parquet(str(tmp_path / "t")).collect()]
    assert sorted(found, key=repr) == sorted([(1, True, 2.5, "x", "2024-02-03", None), (2, False, None, None, None, None), (None, None, None, "y", None, None), (None, False, 1000.0, "z", None, None)], key=repr)
    assert seen.get == {"id": 1, "on": 1, "x": 1, "day": 2}
    kinds = spark.createDataFrame([(k, c) for k, c in enumerate(["insert", "replace", "update", "delete", "read", "update_preimage"])], "id long, _change_type string")
    assert sorted((r.id, r[1]) for r in cdc.from_change_feed(kinds).collect()) == [(0, "I"), (1, "U"), (2, "U"), (3, "D"), (4, "I")]


# Vectors.
@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_inverted_lists(spark, tmp_path, metric):
    """Nine in ten of the exact neighbours; all of them when all lists are probed; equal, null and zero vectors, and equal ids."""
    rng = np.random.default_rng(1)
    rows = [(k, (rng.normal(0, 0.3, 8) + 3 * (k % 9 == np.arange(8))).tolist()) for k in range(3000)]
    rows += [(5000 + k, rows[0][1]) for k in range(300)] + [(7, None), (9000, [0.0] * 8), (1, rows[3][1])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    index = vectors.InvertedLists(df, "id", "v", str(tmp_path / "ivf"), metric)
    assert index.measured >= 0.95 and index.probes < len(index.centres) == 57
    queries = df.filter("id % 50 = 0")
    pairs = lambda found: {(r["query"], r["id"], round(r["distance"], 9)) for r in found.collect()}
    exact = pairs(vectors.nearest_to_each(df, queries, "id", "v", 10, metric))
    assert len(pairs(index.search(queries, "v")) & exact) >= 0.9 * len(exact)
    # Rounding may order equal vectors in another way: distances are the same.
    near = lambda found: sorted((q, round(d, 6)) for q, _, d in found)
    assert near(pairs(index.search(queries, "v", probes=10**6, block=64))) == near(exact)
    plan = index.search(queries, "v")._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    nothing = vectors.InvertedLists(df.limit(0), "id", "v", str(tmp_path / "none"), metric)
    assert nothing.search(queries, "v").count() == 0 and index.search(queries.limit(0), "v").count() == 0


def test_vector_upserts(spark, tmp_path):
    """Rows with vectors by key: replaced, added and deleted in place."""
    path = str(tmp_path / "t")
    put = lambda rows: keyed.merge(path, spark.createDataFrame(rows, "id long, chunk string, embedding array<float>, __opcode string"), ["id"], 8)
    put([(k, f"c{k}", [float(k), 1.0], "I") for k in range(40)])
    put([(3, "new", [0.5, 0.5], "U"), (4, None, None, "D"), (99, "more", [9.0, 9.0], "I")])
    held = keyed.read(spark, path)
    assert held.count() == 40 and vectors.nearest(held, "embedding", [0.5, 0.5], 1).first().id == 3


@pytest.mark.parametrize("name", ["vec_ivf_l2_topk", "vec_ivf_cosine_topk"])
def test_inverted_lists_of_the_table(spark, name):
    rows = catalog.QUERIES[name](spark, oracle.DATA).groupBy("query").count().collect()
    wanted = catalog.table(spark, oracle.DATA, "embeddings").filter("vec_id % 50 = 0").count()
    assert len(rows) == wanted and all(r["count"] == 10 for r in rows)


# Running totals.
def test_running_totals(spark, tmp_path):
    """Totals go on after a restart; null keys and values; a key that was idle for long expires and starts anew."""
    source, target, checkpoint = (str(tmp_path / x) for x in ("in", "t", "c"))
    like = spark.createDataFrame([], "k string, v double, ts timestamp")

    def step(*rows):
        made = spark.createDataFrame([(k, v, f"2024-01-01 {at}") for k, v, at in rows], "k string, v double, ts string").withColumn("ts", F.to_timestamp("ts"))
        made.coalesce(1).write.mode("append").parquet(source)
        totals.keep(streams.files(spark, source, like), target, ["k"], checkpoint, values=["v"], ts="ts", idle_seconds=3600).awaitTermination()
        return {r.k: (r.n, r.sum_v, r.last.strftime("%H:%M")) for r in keyed.read(spark, target).collect()}

    assert step(("a", 1.5, "00:00:00"), ("a", None, "00:10:00"), (None, 2.0, "00:05:00"), ("b", None, "00:20:00")) == {"a": (2, 1.5, "00:10"), None: (1, 2.0, "00:05"), "b": (1, None, "00:20")}
    assert step(("a", 2.0, "00:30:00")) == {"a": (3, 3.5, "00:30"), None: (1, 2.0, "00:05"), "b": (1, None, "00:20")}
    step(("z", 1.0, "05:00:00"))  # the watermark moves on, hours beyond
    found = step(("a", 7.0, "05:10:00"), ("z", 1.0, "05:01:00"))
    assert found == {"a": (1, 7.0, "05:10"), "z": (2, 2.0, "05:01")}
