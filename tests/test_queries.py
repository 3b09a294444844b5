import oracle
import pytest

from millrace import catalog


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    f = catalog.QUERIES[name]
    if name in catalog.ORACLE_SQL:
        oracle.compare(spark, name, f, catalog.ORACLE_SQL[name])
    else:
        assert f(spark, oracle.DATA).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["vec_l2_topk", "vec_cosine_topk"])
def test_nearest_to_each(spark, name, tmp_path):
    """Queries grow with the table, and a table without rows has no result."""
    some = catalog.table(spark, oracle.DATA, "embeddings")
    asked = catalog.QUERIES[f"{name}_each"](spark, oracle.DATA).select("query").distinct().count()
    assert asked == some.filter("vec_id % 50 = 0").count() > 1
    some.limit(0).write.parquet(str(tmp_path / "embeddings.parquet"))
    assert catalog.QUERIES[name](spark, str(tmp_path)).count() == catalog.QUERIES[f"{name}_each"](spark, str(tmp_path)).count() == 0


def test_every_turn(spark):
    last = catalog.table(spark, oracle.DATA, "conversations").agg({"turn": "max"}).first()[0]
    assert {r.turn for r in catalog.QUERIES["eval_jaccard_turns"](spark, oracle.DATA).select("turn").distinct().collect()} == set(range(1, last + 1))
