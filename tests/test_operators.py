import hmac
import json
import threading
from decimal import Decimal
from http.server import BaseHTTPRequestHandler, HTTPServer

import oracle
import pytest
from pyspark.sql import functions as F

from millrace import catalog
from millrace.errors import SpecError, TransformError
from millrace.functions import text as tx
from millrace.operators import blocks, cdc, keyed, masking, quality, sqlstage, stats, textstages
from millrace.plans import lineage, runner, spec
from millrace.sources import registry


@pytest.fixture
def boats(spark):
    rows = [(7, " Heron ", 12, "Oslo"), (8, "tern", None, "Riga"), (9, None, 20, "Oslo"), (11, "tern", 4, "Kiel"), (12, "gull", 4, "Riga")]
    return spark.createDataFrame(rows, "id long, name string, length long, port string")


def ids(df):
    return sorted(r.id for r in df.collect())


def test_blocks(boats):
    b = lambda **k: blocks.apply(boats, k)
    assert ids(b(kind="filter", column="length", operator="gte", value="12")) == [7, 9]
    assert ids(b(kind="filter", column="length", operator="is_null")) == [8]
    for bad in ({"column": "length", "operator": "eq"}, {"column": "a b", "operator": "is_null"}, {"column": "gone", "operator": "is_null"}):
        with pytest.raises(SpecError):
            b(kind="filter", **bad)
    assert b(kind="rename", **{"from": "port", "to": "home"}).columns == ["id", "name", "length", "home"]
    assert b(kind="rename", **{"from": "name", "to": "boat"}).columns == ["id", "length", "port", "boat"]
    assert dict(b(kind="cast", column="length", data_type="float").dtypes)["length"] == "double"
    assert b(kind="fill_nulls", column="length", strategy="column_average").filter("id = 8").first().length == 10.0
    assert b(kind="fill_nulls", column="name", strategy="other_column", fallback_column="port").filter("id = 9").first().name == "Oslo"
    assert [r.length for r in b(kind="sort", column="length").collect()] == [4, 4, 12, 20, None]
    assert [r.length for r in b(kind="sort", column="length", direction="desc").collect()] == [None, 20, 12, 4, 4]
    assert b(kind="dedupe", columns=["port"]).count() == 3
    chained = blocks.chain(boats, [{"kind": "drop_nulls", "columns": ["name"]}, {"kind": "trim", "columns": ["name"]}, {"kind": "sort", "column": "name", "direction": "asc"}])
    assert [r.name for r in chained.collect()] == ["Heron", "gull", "tern", "tern"]
    with pytest.raises(SpecError):
        blocks.chain(boats, [])
    few = blocks.preview(boats.orderBy("id"), [{"kind": "aggregate", "group_by": [], "aggregations": [{"column": "id", "function": "count", "output": "n"}]}], 2)
    assert few.first().n == 2 and json.loads(blocks.preview(boats.orderBy("id"), [{"kind": "trim", "columns": ["name"]}], 1).toJSON().first())["name"] == "Heron"


def test_sql(spark):
    legs = spark.createDataFrame([(1, "n", 40), (2, "n", 15), (3, "s", 9), (4, "s", 31)], "leg long, area string, miles long")
    areas = spark.createDataFrame([("n", "North"), ("s", "South")], "area string, title string")
    run = lambda q: sqlstage.transform({"legs": legs, "areas": areas}, q)
    assert run("SELECT * FROM legs WHERE miles > 14").count() == 3
    assert [r.title for r in run("/* joined */ SELECT title FROM legs JOIN areas ON legs.area = areas.area ORDER BY leg").collect()] == ["North", "North", "South", "South"]
    spark.sql("CREATE TABLE IF NOT EXISTS kept (leg BIGINT) USING parquet")
    try:
        for bad in ("SELECT nothing here is right", "CREATE TABLE x (a INT)", "WITH a AS (SELECT leg FROM legs) INSERT INTO kept SELECT leg FROM a", "FROM legs INSERT INTO kept SELECT leg", "FROM legs INSERT INTO kept SELECT leg INSERT INTO kept SELECT miles", "INSERT INTO kept VALUES (1)", "SET a = 1", "DROP VIEW legs", "TRUNCATE TABLE kept", "EXPLAIN SELECT 1", "", None):
            with pytest.raises(TransformError):
                run(bad)
        assert spark.table("kept").count() == 0
    finally:
        spark.sql("DROP TABLE kept")


def test_sql_leaves_the_caller_alone(spark):
    """Views of the caller with an input's name stay what they are, and its settings too."""
    spark.range(3).createOrReplaceTempView("mine")
    before = spark.conf.get("spark.sql.ansi.doubleQuotedIdentifiers")
    out = sqlstage.transform({"mine": spark.range(5)}, 'SELECT "id" FROM mine')
    assert out.count() == 5 and spark.table("mine").count() == 3
    assert spark.conf.get("spark.sql.ansi.doubleQuotedIdentifiers") == before
    with pytest.raises(TransformError):  # nor are they seen
        sqlstage.transform({"other": spark.range(5)}, "SELECT * FROM mine")
    assert out.join(spark.range(2), "id").count() == 2
    spark.catalog.dropTempView("mine")


def test_lineage(spark):
    legs = spark.createDataFrame([(1, "n", 40)], "leg long, area string, miles long")
    areas = spark.createDataFrame([("n", "North")], "area string, title string")
    of = lambda q: lineage.column_lineage(sqlstage.transform({"legs": legs, "areas": areas}, q))
    assert of("SELECT leg, miles * leg AS t FROM legs") == {"leg": ["leg"], "t": ["leg", "miles"]}
    assert of("SELECT area, max(miles) AS s FROM legs GROUP BY area") == {"area": ["area"], "s": ["miles"]}
    assert of("SELECT leg FROM legs UNION ALL SELECT leg FROM legs") == {"leg": None}
    assert of("SELECT title, miles FROM legs JOIN areas ON legs.area = areas.area") == {"title": ["title"], "miles": ["miles"]}
    assert "miles" in of("SELECT rank() OVER (ORDER BY miles) AS r FROM legs")["r"]


def test_quality(spark):
    df = spark.createDataFrame([(5, -2.0, "open"), (5, 300.0, "odd"), (None, 10.0, None), (5, 11.0, "open")], "id long, price double, state string")
    checks = [("id", {"kind": "not_null"}), ("id", {"kind": "unique"}), ("price", {"kind": "min", "min": 0}), ("price", {"kind": "max", "max": 250}), ("state", {"kind": "accepted_values", "values": ["open"]}), ("gone", {"kind": "not_null"}), ("", {"kind": "row_count", "max": 3}), ("state", {"kind": "unique"})]
    found = quality.run_checks(df, [{"column": c, "check": k} for c, k in checks]).collect()
    assert [r.violation_count for r in found] == [1, 2, 1, 1, 1, None, 4, 1]
    assert all(r.status == "fail" for r in found) and "odd" in found[4].message and "not found" in found[5].message
    empty = quality.run_checks(df.limit(0), [{"column": c, "check": k} for c, k in checks[:5]] + [{"column": "", "check": {"kind": "row_count", "min": 1}}]).collect()
    assert [r.status for r in empty] == ["pass"] * 5 + ["fail"]


def test_masking(spark):
    df = spark.createDataFrame([(1, "kit", 3.0), (2, None, 3.25), (3, "kit", 1e20), (4, "", -2.5e-7), (5, "k", 1.25e7)], "id long, who string, x double")
    rows = masking.mask(df, ["who", "x", "absent"], "grain of salt").orderBy("id").collect()
    token = lambda v: hmac.digest(b"grain of salt", v.encode(), "sha256").hex()[:32]
    assert [r.who for r in rows] == [token("kit"), None, token("kit"), token(""), token("k")]
    assert [r.x for r in rows] == [token(v) for v in ("3", "3.25", "100000000000000000000", "-0.00000025", "12500000")]
    with pytest.raises(SpecError):
        masking.mask(df, ["who"], None)


def test_shown_doubles(spark):
    values = [0.0, -0.5, 1.0, 1e7, 1.5e7, 123456789.125, 1e15, 1.7976931348623157e308, 2.5e-300, 1e-3, 9.99e-4, -3e22]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select("x", tx.shown(F.col("x"), "double").alias("s")).collect()
    for r in rows:
        assert "E" not in r.s and not r.s.endswith(".0") and float(r.s) == r.x and Decimal(r.s) == Decimal(repr(r.x)), r


def test_changes(spark, tmp_path):
    df = spark.createDataFrame([(21, "D"), (22, "I"), (23, "U"), (24, "D")], "id long, __opcode string")
    up, down = cdc.split(df)
    assert ids(up) == [22, 23] and ids(down) == [21, 24] and up.columns == ["id"]
    assert cdc.split(df.select("id")) is None
    for code in (None, "Z"):
        with pytest.raises(Exception, match="bad opcode"):
            cdc.split(spark.createDataFrame([(1, code)], "id long, __opcode string"))[0].collect()
    with pytest.raises(Exception, match="unknown change"):
        cdc.from_change_feed(spark.createDataFrame([(1, "moved")], "id long, _change_type string")).collect()


@pytest.mark.parametrize("kind", ["parquet", "csv"])
def test_merged_files(spark, tmp_path, kind):
    path, config = str(tmp_path / kind), {"primary_key": "id"}
    sink = lambda rows, schema: registry.write(spark.createDataFrame(rows, schema), kind, {"path": path, **config})
    sink([(1, "red"), (2, "blue"), (3, "green"), (None, "none")], "id long, hue string")
    sink([(1, "black", "U"), (2, None, "D"), (4, "white", "I"), (None, "grey", "U")], "id long, hue string, __opcode string")
    found = spark.read.schema("id long, hue string").options(header=True).format(kind).load(path)
    assert sorted(((r.id, r.hue) for r in found.collect()), key=repr) == [(1, "black"), (3, "green"), (4, "white"), (None, "grey")]
    assert [p.name for p in tmp_path.iterdir()] == [kind]


def test_null_keys(spark):
    old = spark.createDataFrame([(None, 1), (5, 2)], "k long, v long")
    assert sorted(r.v for r in cdc.merge(old, spark.createDataFrame([(None, 9)], "k long, v long"), ["k"]).collect()) == [2, 9]
    assert sorted(r.v for r in cdc.insert_if_absent(old, spark.createDataFrame([(None, 9), (6, 7)], "k long, v long"), ["k"]).collect()) == [1, 2, 7]


def test_failed_swap(spark, tmp_path, monkeypatch):
    """A rename that fails leaves the table readable under its name."""
    path = str(tmp_path / "t")
    cdc.merge_files(path, spark.createDataFrame([(1, "a")], "id long, v string"), ["id"])
    renamed, calls = cdc._renamed, []

    def second_fails(fs, old, new):
        calls.append(old)
        if len(calls) == 2:
            raise OSError("no")
        renamed(fs, old, new)

    monkeypatch.setattr(cdc, "_renamed", second_fails)
    with pytest.raises(OSError):
        cdc.merge_files(path, spark.createDataFrame([(1, "b")], "id long, v string"), ["id"])
    assert spark.read.parquet(path).first().v == "a"


def plain_pieces(text, size, separators):
    """Recursive cutting, told again: join neighbours while they fit, cut what doesn't fit by the next separator."""
    if not text:
        return []
    if len(text) <= size:
        return [text]
    if not separators or not separators[0]:
        return [text[k : k + size] for k in range(0, len(text), size)]
    sep, out, now = separators[0], [], ""
    for part in text.split(sep):
        if len(part) > size:
            out, now = out + ([now] if now else []) + plain_pieces(part, size, separators[1:]), ""
        elif not now:
            now = part
        elif len(now) + len(sep) + len(part) <= size:
            now += sep + part
        else:
            out, now = [*out, now], part
    return out + ([now] if now else [])


def test_chunks(spark):
    def fixed(t, size, overlap):
        return spark.range(1).select(tx.fixed_windows(F.lit(t), size, overlap).alias("c")).first().c

    assert fixed("0123456789", 4, 1) == ["0123", "3456", "6789"] and fixed("0123456789A", 4, 0) == ["0123", "4567", "89A"]
    assert fixed("xy", 9, 3) == ["xy"] and fixed("ßøæłđ", 3, 0) == ["ßøæ", "łđ"] and fixed("", 3, 0) == []
    split = textstages.split_recursively
    assert split("one small line\n\nand one more line", 18, ["\n\n", " ", ""]) == ["one small line", "and one more line"]
    assert split("\n\nxyz\n\nuvwxy", 6, textstages.SEPARATORS) == ["xyz", "uvwxy"]
    assert split("qwertyu", 3, [""]) == ["qwe", "rty", "u"] and textstages.with_overlap(split("qwertyu", 3, [""]), 1, 3) == ["qwe", "erty", "yu"]
    for text in ("abcdef  gh ij", " a  b ", "\n\n\n\nx", "aa. bb. cc dd\nee\n\nff" * 3, "word" * 40, ""):
        for size in (1, 2, 5, 11, 64):
            assert split(text, size, textstages.SEPARATORS) == plain_pieces(text, size, textstages.SEPARATORS), (text, size)


def test_recursive_chunks_of_the_table(spark):
    docs = catalog.table(spark, oracle.DATA, "documents").select("doc_id", "text").collect()
    want = sorted((d.doc_id, k, c) for d in docs for k, c in enumerate(textstages.with_overlap(plain_pieces(d.text or "", 512, ["\n\n", "\n", ". ", " ", ""]), 64, 512)))
    assert sorted((r.doc_id, r.chunk_index, r.text) for r in catalog.QUERIES["chunk_recursive"](spark, oracle.DATA).collect()) == want


def test_semantic_chunks(spark):
    vector = {"Tea.": [1, 0], "Milk.": [0.95, 0.2], "Coal.": [0, 1]}
    rows = [(1, "Tea. Milk. Coal.", "x"), (1, "Tea. Milk. Coal.", "x"), (1, "Coal. Coal.", "y"), (2, None, "z"), (3, "", "z")]
    df = spark.createDataFrame(rows, "id long, t string, other string")
    found = textstages.semantic_chunks(df, "t", 2, 0.8, lambda ts, d: [vector[t] for t in ts])
    assert found.columns == ["id", "t", "other", "chunk_index"]
    assert sorted(tuple(r) for r in found.collect()) == sorted([(1, "Tea. Milk.", "x", 0), (1, "Coal.", "x", 1)] * 2 + [(1, "Coal. Coal.", "y", 0)])


def test_semantic_chunks_of_the_table(spark):
    """All sentences come back, in order, cut where neighbours differ."""
    docs = {r.doc_id: r.s for r in catalog.table(spark, oracle.DATA, "documents").select("doc_id", tx.sentences(F.col("text")).alias("s")).collect()}
    found = {}
    for r in catalog.QUERIES["chunk_semantic"](spark, oracle.DATA).orderBy("doc_id", "chunk_index").collect():
        found.setdefault(r.doc_id, []).append(r.text)
    for i, sentences in docs.items():
        v = textstages.hash_embed(sentences, 32).astype(float)
        chunks = []
        for k, s in enumerate(sentences):
            if k and v[k - 1] @ v[k] / max((v[k - 1] @ v[k - 1]) ** 0.5 * (v[k] @ v[k]) ** 0.5, 1e-30) >= 0.1:
                chunks[-1] += " " + s
            else:
                chunks.append(s)
        assert found.get(i, []) == chunks


def test_embedding_of_the_table(spark):
    rows = catalog.QUERIES["embed"](spark, oracle.DATA).select("text", "vector").collect()
    assert len(rows) == catalog.table(spark, oracle.DATA, "documents").filter("length(text) > 0").count()
    want = textstages.hash_embed([r.text for r in rows], 16)
    assert all(abs(x - y) < 1e-6 for r, w in zip(rows, want.tolist(), strict=True) for x, y in zip(r.vector, w, strict=True))


def test_model_calls(spark, tmp_path):
    asked = str(tmp_path / "asked")

    def backend(prompts):
        with open(asked, "a") as f:
            f.writelines(p + "\n" for p in prompts)
        return [p.upper() for p in prompts]

    df = spark.createDataFrame([(1, "fog"), (2, "fog"), (3, None)], "id long, w string")
    calls = lambda: len(open(asked).read().splitlines())
    ask = lambda d, **k: {r.id: r.reply for r in textstages.complete(d, "say {w}", ["w"], "reply", backend, **k).collect()}
    assert ask(df) == {1: "SAY FOG", 2: "SAY FOG", 3: "SAY "} and calls() == 2
    cache = str(tmp_path / "cache")
    assert ask(df, cache=cache) == {1: "SAY FOG", 2: "SAY FOG", 3: "SAY "}
    before = calls()
    assert ask(df, cache=cache, ttl_seconds=3600)[1] == "SAY FOG" and calls() == before
    assert ask(df.unionByName(spark.createDataFrame([(4, "sun")], "id long, w string")), cache=cache)[4] == "SAY SUN" and calls() == before + 1
    assert ask(df, cache=cache, model="other")[3] == "SAY " and calls() == before + 3
    assert textstages.cost(spark.createDataFrame([(2000, 500), (1000, 0)], "p long, r long"), "p", "r", 0.5, 2.0).first().cost == 2.5
    assert textstages.context(["a", "b"], "why?") == "[1] a\n\n[2] b\n\nwhy?"
    with pytest.raises(LookupError):
        textstages.context([], "why?")


def test_scores(spark):
    row = lambda c: spark.range(1).select(c.alias("x")).first().x
    sim = lambda a, b: row(tx.token_similarity(F.lit(a), F.lit(b)))
    assert sim("Boats, boats and tides", "tides and wind") == 0.5 and sim("", "!") == 1.0 and sim("x", "y") == 0.0
    judge = lambda s: row(tx.judge_score(F.lit(s)))
    assert (judge("6"), judge("9 of ten"), judge("11.5"), judge("-3"), judge("none")) == (0.6, 0.9, 1.0, 0.0, None)
    assert row(tx.title_case(F.lit("d'arc foo-bar ÆON 3rd"))) == "D'Arc Foo-Bar Æon 3rd"


@pytest.mark.parametrize("history,now,expected", [([40, 44, 41], 9e5, "none"), ([40, 42, 38, 41, 39], 40, "none"), ([40, 42, 38, 41, 39], 43.5, "warning"), ([40, 42, 38, 41, 39], 2, "critical"), ([6] * 7, 7, "warning"), ([6] * 7, 6, "none")])
def test_anomaly(spark, history, now, expected):
    df = spark.createDataFrame([("p", i, float(v)) for i, v in enumerate([*history, now])], "p string, run int, v double")
    assert stats.anomalies(df, ["p"], ["run"], "v").orderBy(F.desc("run")).first().severity == expected


def test_statistics(spark):
    rows = spark.createDataFrame([(0, 3, 1.0), (30, 4, 2.0), (200, 10, 5.0)], "s long, n long, x double").withColumn("ts", F.timestamp_seconds("s"))
    found = sorted(tuple(r) for r in stats.buckets(rows, "ts", ["n", "x"], 60).collect())
    assert found == [(0, 3, 1.5), (3, 10, 5.0)]
    assert stats.bucket_seconds(3600, 60, 10) == 60 and stats.bucket_seconds(100, 60, 10) == 10
    old, new = spark.createDataFrame([], "a long, b string, c double").schema, spark.createDataFrame([], "c double, a string, d long").schema
    assert stats.drift(old, new) == ["+d", "-b", "a: bigint→string"] and stats.drift(old, old) == []
    known = spark.createDataFrame([("t", "a", "long", "the key"), ("t", "b", "string", None)], "dataset string, name string, type string, note string")
    merged = stats.merge_columns(known, spark.createDataFrame([("t", "a", "int"), ("t", "z", "date"), ("t", "z", "date")], "dataset string, name string, type string"))
    assert sorted((tuple(r) for r in merged.collect()), key=repr) == [("t", "a", "int", "the key"), ("t", "b", "string", None), ("t", "z", "date", None)]
    x = "array<struct<connector:string,identifier:string>>"
    specs = spark.createDataFrame([("p", [("csv", "in")], [("parquet", "mid")]), ("q", [("parquet", "mid"), ("csv", None)], [("kafka", "out")])], f"pipeline_id string, sources {x}, sinks {x}")
    assert sorted(tuple(r) for r in stats.lineage_edges(specs).collect()) == [("pipeline::p", "resource::parquet::mid"), ("pipeline::q", "resource::kafka::out"), ("resource::csv::in", "pipeline::p"), ("resource::parquet::mid", "pipeline::q")]
    tagged = spark.createDataFrame([("Sales", ["pii"]), ("sales", ["raw"]), ("other", ["pii"])], "name string, tags array<string>")
    assert [r.name for r in stats.search(tagged, "SALE", ["name"], tag="pii").collect()] == ["Sales"]


def test_json_and_sqlite(spark, tmp_path):
    assert registry.infer_json([{"k": None, "m": 4}, {"k": "x", "o": [1], "m": 0.5}]) == "`k` string, `m` bigint, `o` string"
    rows = registry.json_rows(spark, [{"sku": "Q7", "n": 6}, {"sku": 77, "n": 0.5}, {"sku": {"a": [1]}}]).collect()
    assert [tuple(r) for r in rows] == [("Q7", 6), ("77", None), ('{"a":[1]}', None)]
    with pytest.raises(SpecError):
        registry.json_rows(spark, [], "t timestamp")
    import sqlite3

    with sqlite3.connect(tmp_path / "d.db") as db:
        db.execute("CREATE TABLE t (id INTEGER, name TEXT)")
        db.executemany("INSERT INTO t VALUES (?, ?)", [(k, None if k % 3 == 0 else f"n{k}") for k in range(1000)])
    found = registry.read(spark, "sqlite", {"path": str(tmp_path / "d.db"), "table": "t", "rows_per_task": 64})
    assert sorted(tuple(r) for r in found.collect() if r.name) == sorted((k, f"n{k}") for k in range(1000) if k % 3) and found.count() == 1000
    with pytest.raises(SpecError):
        registry.write(spark.range(1), "parquet", {"path": str(tmp_path / "x"), "compression": "arj"})
    with pytest.raises(SpecError):
        registry.read(spark, "nothing", {})


def test_rest_and_webhook(spark):
    """Pages by offset, with a total and without, by cursor, and rows that are posted."""
    rows, posted = [{"id": k, "tag": None if k % 5 == 0 else f"t{k}"} for k in range(230)], []

    class Service(BaseHTTPRequestHandler):
        def do_GET(self):
            import urllib.parse

            at = urllib.parse.urlparse(self.path)
            ask = {k: int(v[0]) for k, v in urllib.parse.parse_qs(at.query).items()}
            first = ask.get("offset", ask.get("cursor", 0))
            body = {"data": {"rows": rows[first : first + 50]}, "total": len(rows)}
            if at.path == "/cursor" and first + 50 < len(rows):
                body["next"] = first + 50
            reply = json.dumps(body).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(reply)

        def do_POST(self):
            posted.extend(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))
            self.send_response(200)
            self.end_headers()

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        url = f"http://127.0.0.1:{server.server_address[1]}"
        base = {"rows_path": "data.rows", "page_size": 50}
        for more in ({"url": f"{url}/o", "pagination": "offset", "total_path": "total"}, {"url": f"{url}/o", "pagination": "offset"}, {"url": f"{url}/cursor", "pagination": "cursor", "cursor_path": "next"}):
            found = registry.read(spark, "rest", base | more)
            assert sorted((r.id, r.tag) for r in found.collect() if r.tag) == sorted((r["id"], r["tag"]) for r in rows if r["tag"]) and found.count() == 230, more
            with pytest.raises(SpecError):
                registry.read(spark, "rest", base | more | {"max_pages": 2})
        registry.write(spark.range(7), "webhook", {"url": url})
        assert sorted(r["id"] for r in posted) == list(range(7))
    finally:
        server.shutdown()


def csv_spec(tmp_path, **more):
    (tmp_path / "in.csv").write_text("code,who,score\n10,Ada Lem,3\n11,Bo,18\n12,Cy,44\n")
    base = {"pipeline_id": "p1", "sources": [{"connector": "csv", "config": {"path": str(tmp_path / "in.csv")}}], "sinks": [{"connector": "csv", "config": {"path": str(tmp_path / "out")}}]}
    return {**base, **more}


def test_pipeline(spark, tmp_path):
    p = csv_spec(tmp_path, clean_blocks=[{"kind": "filter", "column": "score", "operator": "gt", "value": "9"}, {"kind": "rename", "from": "who", "to": "player"}, {"kind": "sort", "column": "code", "direction": "asc"}],
                 quality_checks=[{"column": "code", "check": {"kind": "unique"}}])
    done = runner.run(spark, p, ledger=str(tmp_path / "ledger"))
    assert done["written"] == ["sink0"] and done["checks"].first().status == "pass" and done["rows"] == 2 and done["seconds"] > 0
    out = spark.read.csv(str(tmp_path / "out"), header=True)
    assert out.columns == ["code", "score", "player"] and sorted(tuple(r) for r in out.collect()) == [("11", "18", "Bo"), ("12", "44", "Cy")]
    assert runner.run(spark, p, ledger=str(tmp_path / "ledger"))["written"] == []
    for bad in ({"pipeline_id": ""}, {**p, "sinks": []}, {**p, "transform": {"sql": "SELECT 1"}}, {**p, "depends_on": [{"upstream_pipeline_id": "p1"}]}):
        with pytest.raises(SpecError):
            spec.parse(bad)


def test_two_sinks(spark, tmp_path):
    sinks = [{"connector": "parquet", "config": {"path": str(tmp_path / "a")}}, {"connector": "json", "config": {"path": str(tmp_path / "b")}}]
    done = runner.run(spark, csv_spec(tmp_path, sinks=sinks, transform={"sql": "SELECT who, score * 2 AS twice FROM source0"}))
    assert done["written"] == ["sink0", "sink1"] and done["rows"] == 3
    assert sorted(r.twice for r in spark.read.parquet(str(tmp_path / "a")).collect()) == sorted(r.twice for r in spark.read.json(str(tmp_path / "b")).collect()) == [6, 36, 88]


def test_stages_of_a_specification(spark, tmp_path):
    """Every stage runs or raises; none is passed over."""
    llm = {"prompt": {"name": "hail"}, "input_columns": ["who"], "output_column": "hello"}
    p = csv_spec(tmp_path, llm=llm)
    with pytest.raises(SpecError):
        runner.run(spark, p)
    runner.run(spark, p, prompts={"hail": "ahoy {who}"}, backend=lambda prompts: [x.title() for x in prompts])
    assert sorted(r.hello for r in spark.read.csv(str(tmp_path / "out"), header=True).collect()) == ["Ahoy Ada Lem", "Ahoy Bo", "Ahoy Cy"]
    script = {"script": "def transform(pdf):\n    return pdf.assign(score=pdf.score + 1)[pdf.score > 3]"}
    runner.run(spark, csv_spec(tmp_path, python=script))
    assert sorted(r.score for r in spark.read.csv(str(tmp_path / "out"), header=True).collect()) == ["19", "45"]
    embedding = {"source_column": "who", "output_column": "v", "dimension": 4, "chunking": {"strategy": "semantic", "similarity_threshold": 0.5}}
    sinks = [{"connector": "parquet", "config": {"path": str(tmp_path / "vectors")}}]
    runner.run(spark, csv_spec(tmp_path, embedding=embedding, sinks=sinks))
    found = spark.read.parquet(str(tmp_path / "vectors"))
    assert found.columns == ["code", "who", "score", "v"] and found.count() == 3
    for odd in ({"visualization": {"script": "x"}, "python": script}, {"dbt": {"project_dir": str(tmp_path), "command": "run"}}):
        with pytest.raises(SpecError):
            runner.run(spark, csv_spec(tmp_path, **odd))


def test_mirror(spark, tmp_path):
    from millrace.streaming import streams

    src = str(tmp_path / "changes")
    batches = [[(1, "a", "I", 1), (2, "b", "I", 2)], [(1, "c", "U", 3), (2, None, "D", 4)], [(3, "z", "I", 5)]]

    def add(rows):
        spark.createDataFrame(rows, "id long, v string, __opcode string, seq long").coalesce(1).write.mode("append").parquet(src)

    def catch_up():
        streams.mirror(streams.files(spark, src, like, each=1), str(tmp_path / "t"), ["id"], str(tmp_path / "c"), ["seq"]).awaitTermination(60)
        return sorted((r.id, r.v) for r in keyed.read(spark, str(tmp_path / "t")).collect())

    add(batches[0])
    like = spark.read.parquet(src)
    assert catch_up() == [(1, "a"), (2, "b")]
    add(batches[1])
    add(batches[2])
    assert catch_up() == [(1, "c"), (3, "z")]  # goes on where the run before ended


def test_windows_of_a_stream(spark, tmp_path):
    """A stream gives the windows that a table gives, and drops events that come again."""
    from millrace.streaming import streams

    src = str(tmp_path / "e")
    rows = [(k, f"2024-01-01 00:{k % 60:02d}:00", "ab"[k % 2]) for k in range(40)]
    df = spark.createDataFrame(rows, "id long, ts string, kind string").withColumn("ts", F.to_timestamp("ts"))
    df.unionByName(df.limit(5)).coalesce(1).write.parquet(src)
    stream = lambda: streams.unique_events(streams.files(spark, src, df), ["id"], "ts", "1 hour")

    def run(made, mode, name):
        made.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination(60)
        return sorted(tuple(r) for r in spark.table(name).collect())

    assert len(run(stream(), "append", "once")) == 40
    files = lambda: streams.files(spark, src, df).dropDuplicates(["id"])
    assert run(streams.tumbling(files(), "ts", "10 minutes", ["kind"]), "complete", "fixed") == sorted(tuple(r) for r in streams.tumbling(df, "ts", "10 minutes", ["kind"]).collect())
