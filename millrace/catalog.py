"""Registered queries of the library and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as tx
from .functions import vectors
from .operators import blocks, cdc, joins, keyed, masking, quality, sqlstage, stats, textstages
from .session import scratch
from .sources import registry
from .streaming import streams, totals


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None, *tables: str):
    """Registers a function of the named tables and its SQL."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(*[table(spark, sf_dir, t) for t in tables])
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue and orders by nation and order priority: two joins with small sides and one aggregate."""
    return QUERIES["flagship"](spark, sf_dir)


@query("flagship", """SELECT n_name, o_orderpriority, count(*) AS n_orders, round(sum(o_totalprice), 2) AS revenue
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice > 1000 GROUP BY 1, 2""", "orders", "customer", "nation")
def _flagship(orders, customer, nation):
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.filter("o_totalprice > 1000").groupBy("n_name", "o_orderpriority").agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("revenue"))


# Blocks: name, table, columns kept first, blocks, SQL.
ORDERS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority"
PARTS = "p_partkey, p_name, p_brand, p_size, p_retailprice"
LEFT = "(SELECT c_custkey, c_name, o_orderkey, o_orderstatus, o_totalprice FROM customer LEFT JOIN orders ON c_custkey = o_custkey)"


def _block(name: str, source: str, chain: list[dict], sql: str) -> None:
    if source == "left":
        def run(spark, d):
            c, o = table(spark, d, "customer"), table(spark, d, "orders")
            df = c.join(o, c.c_custkey == o.o_custkey, "left").select("c_custkey", "c_name", "o_orderkey", "o_orderstatus", "o_totalprice")
            return blocks.chain(df, chain)
    else:
        def run(spark, d):
            columns = {"orders": ORDERS, "part": PARTS}.get(source, "*")
            return blocks.chain(table(spark, d, source.split("_")[0]).select(*columns.split(", ")), chain)
    QUERIES[name], ORACLE_SQL[name] = run, sql


for _op, _sign in (("eq", "="), ("ne", "<>"), ("gt", ">"), ("lt", "<"), ("gte", ">="), ("lte", "<=")):
    _block(f"blk_filter_{_op}", "part", [{"kind": "filter", "column": "p_size", "operator": _op, "value": "25"}], f"SELECT {PARTS} FROM part WHERE p_size {_sign} 25")
_block("blk_filter_contains", "part", [{"kind": "filter", "column": "p_name", "operator": "contains", "value": "a"}], f"SELECT {PARTS} FROM part WHERE p_name LIKE '%a%'")
_block("blk_filter_starts_with", "part", [{"kind": "filter", "column": "p_brand", "operator": "starts_with", "value": "Brand#1"}], f"SELECT {PARTS} FROM part WHERE p_brand LIKE 'Brand#1%'")
_block("blk_filter_is_null", "left", [{"kind": "filter", "column": "o_orderkey", "operator": "is_null"}], f"SELECT * FROM {LEFT} WHERE o_orderkey IS NULL")
_block("blk_filter_is_not_null", "left", [{"kind": "filter", "column": "o_orderkey", "operator": "is_not_null"}], f"SELECT * FROM {LEFT} WHERE o_orderkey IS NOT NULL")
_block("blk_select_keep", "orders", [{"kind": "select_columns", "mode": "keep", "columns": ["o_totalprice", "o_orderkey"]}], "SELECT o_totalprice, o_orderkey FROM orders")
_block("blk_select_drop", "orders", [{"kind": "select_columns", "mode": "drop", "columns": ["o_custkey", "o_orderstatus"]}], "SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders")
_block("blk_rename", "orders", [{"kind": "rename", "from": "o_custkey", "to": "customer"}], "SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority, o_custkey AS customer FROM orders")
for _kind, _sql in (("int", "CAST(trunc(o_totalprice) AS BIGINT)"), ("text", "CAST(o_custkey AS VARCHAR)"), ("float", "CAST(o_custkey AS DOUBLE)")):
    _c = "o_totalprice" if _kind == "int" else "o_custkey"
    _block(f"blk_cast_{_kind}", "orders", [{"kind": "cast", "column": _c, "data_type": _kind}, {"kind": "select_columns", "mode": "keep", "columns": ["o_orderkey", _c]}], f"SELECT o_orderkey, {_sql} AS {_c} FROM orders")
_block("blk_cast_boolean", "part", [{"kind": "cast", "column": "p_size", "data_type": "boolean"}, {"kind": "select_columns", "mode": "keep", "columns": ["p_partkey", "p_size"]}], "SELECT p_partkey, CAST(p_size AS BOOLEAN) AS p_size FROM part")
_block("blk_cast_date", "orders_dates", [{"kind": "cast", "column": "o_orderdate", "data_type": "date"}, {"kind": "select_columns", "mode": "keep", "columns": ["o_orderkey", "o_orderdate"]}], "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate FROM orders")
_block("blk_replace_text", "orders", [{"kind": "replace_text", "column": "o_orderpriority", "find": "-", "replace": " / "}], "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, replace(o_orderpriority, '-', ' / ') AS o_orderpriority FROM orders")
_block("blk_fill_value", "left", [{"kind": "fill_nulls", "column": "o_orderstatus", "strategy": "value", "value": "none"}], f"SELECT * REPLACE (coalesce(o_orderstatus, 'none') AS o_orderstatus) FROM {LEFT}")
_block("blk_fill_average", "left", [{"kind": "fill_nulls", "column": "o_orderkey", "strategy": "column_average"}], f"SELECT * REPLACE (coalesce(CAST(o_orderkey AS DOUBLE), (SELECT avg(o_orderkey) FROM {LEFT})) AS o_orderkey) FROM {LEFT}")
_block("blk_fill_other", "left", [{"kind": "fill_nulls", "column": "o_orderstatus", "strategy": "other_column", "fallback_column": "c_name"}], f"SELECT * REPLACE (coalesce(o_orderstatus, c_name) AS o_orderstatus) FROM {LEFT}")
_block("blk_drop_nulls", "left", [{"kind": "drop_nulls", "columns": ["o_orderkey", "o_orderstatus"]}], f"SELECT * FROM {LEFT} WHERE o_orderkey IS NOT NULL AND o_orderstatus IS NOT NULL")
_block("blk_dedupe_all", "orders", [{"kind": "select_columns", "mode": "keep", "columns": ["o_orderstatus", "o_orderpriority"]}, {"kind": "dedupe", "columns": []}], "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
_block("blk_dedupe_keys", "orders", [{"kind": "dedupe", "columns": ["o_custkey"], "order_by": ["o_orderkey"]}], f"SELECT DISTINCT ON (o_custkey) {ORDERS} FROM orders ORDER BY o_custkey, o_orderkey")
for _mode in ("upper", "lower"):
    _block(f"blk_case_{_mode}", "part", [{"kind": "change_case", "column": "p_name", "mode": _mode}], f"SELECT p_partkey, {_mode}(p_name) AS p_name, p_brand, p_size, p_retailprice FROM part")
_block("blk_case_title", "part", [{"kind": "change_case", "column": "p_name", "mode": "title"}, {"kind": "select_columns", "mode": "keep", "columns": ["p_partkey", "p_name"]}],
       r"SELECT p_partkey, coalesce(list_aggregate(list_transform(regexp_extract_all(p_name, '([\p{L}\p{N}]+|[^\p{L}\p{N}]+)'), lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', ''), '') AS p_name FROM part")
_block("blk_trim", "part", [{"kind": "replace_text", "column": "p_brand", "find": "Brand", "replace": "  "}, {"kind": "trim", "columns": ["p_brand"]}], "SELECT p_partkey, p_name, trim(replace(p_brand, 'Brand', '  ')) AS p_brand, p_size, p_retailprice FROM part")
for _op, _sql in (("add", "p_partkey + p_size"), ("subtract", "p_partkey - p_size"), ("multiply", "p_partkey * p_size"), ("divide", "p_partkey // p_size"), ("concat", "CAST(p_partkey AS VARCHAR) || CAST(p_size AS VARCHAR)")):
    _block(f"blk_compute_{_op}", "part", [{"kind": "computed_column", "output": "made", "left": "p_partkey", "operator": _op, "right": "p_size"}, {"kind": "select_columns", "mode": "keep", "columns": ["p_partkey", "made"]}], f"SELECT p_partkey, {_sql} AS made FROM part")
_AGGREGATES = [{"column": "o_totalprice", "function": f, "output": f"x_{f}"} for f in ("min", "max", "count")] + [{"column": "o_custkey", "function": "count_distinct", "output": "customers"}, {"column": "o_custkey", "function": "sum", "output": "total"}, {"column": "o_custkey", "function": "avg", "output": "mean"}]
_SQL_AGGREGATES = "min(o_totalprice) AS x_min, max(o_totalprice) AS x_max, count(o_totalprice) AS x_count, count(DISTINCT o_custkey) AS customers, CAST(sum(o_custkey) AS BIGINT) AS total, avg(o_custkey) AS mean"
_block("blk_aggregate_all", "orders", [{"kind": "aggregate", "group_by": ["o_orderstatus"], "aggregations": _AGGREGATES}], f"SELECT o_orderstatus, {_SQL_AGGREGATES} FROM orders GROUP BY 1")
_block("blk_aggregate_global", "orders", [{"kind": "aggregate", "group_by": [], "aggregations": _AGGREGATES}], f"SELECT {_SQL_AGGREGATES} FROM orders")
_block("blk_aggregate_keys_only", "orders", [{"kind": "aggregate", "group_by": ["o_orderpriority"], "aggregations": []}], "SELECT DISTINCT o_orderpriority FROM orders")
_block("blk_chain", "orders", [{"kind": "filter", "column": "o_totalprice", "operator": "gt", "value": "1000"}, {"kind": "rename", "from": "o_orderstatus", "to": "status"}, {"kind": "aggregate", "group_by": ["status"], "aggregations": [{"column": "o_orderkey", "function": "count", "output": "n"}]}, {"kind": "sort", "column": "n", "direction": "desc"}], "SELECT o_orderstatus AS status, count(o_orderkey) AS n FROM orders WHERE o_totalprice > 1000 GROUP BY 1")


def _sort_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(*ORDERS.split(", "))
    return blocks.chain(orders, [{"kind": "filter", "column": "o_orderstatus", "operator": "eq", "value": "O"}, {"kind": "sort", "column": "o_orderkey", "direction": "desc"}]).limit(20)


QUERIES["blk_sort_limit"] = _sort_limit
ORACLE_SQL["blk_sort_limit"] = f"SELECT {ORDERS} FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderkey DESC LIMIT 20"


# SQL stage: name, tables, SQL for Spark, SQL for the comparison if it differs.
def _sql(name: str, tables: str, sql: str, other: str | None = None) -> None:
    QUERIES[name] = lambda spark, d: sqlstage.transform({t: table(spark, d, t) for t in tables.split()}, sql)
    ORACLE_SQL[name] = other or sql


_C_O = "customer orders"
_sql("sql_join_inner", _C_O, 'SELECT "c_name", o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey')
for _join in ("left", "right", "full"):
    _sql(f"sql_join_{_join}", _C_O, f"SELECT c_custkey, o_orderkey FROM customer {_join.upper()} JOIN orders ON c_custkey = o_custkey AND o_totalprice > 1500")
_sql("sql_join_semi", _C_O, "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
_sql("sql_join_anti", _C_O, "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
_sql("sql_join_in", _C_O, "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
_sql("sql_join_cross", "region nation", "SELECT r_name, n_name FROM region CROSS JOIN nation")
_sql("sql_join_theta", "region nation", "SELECT r_regionkey, n_nationkey FROM region JOIN nation ON r_regionkey < n_regionkey")
_sql("sql_window_rank", "orders", "SELECT o_orderkey, rank() OVER (PARTITION BY o_orderpriority, o_custkey ORDER BY o_totalprice) AS r, dense_rank() OVER (PARTITION BY o_orderpriority, o_custkey ORDER BY o_orderstatus) AS d FROM orders")
_sql("sql_window_row_number", "orders", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS q FROM orders")
_sql("sql_window_lag_lead", "orders", "SELECT o_orderkey, lag(o_orderkey) OVER w AS before, lead(o_orderkey) OVER w AS after, first_value(o_orderkey) OVER w AS first FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
_sql("sql_window_rows_frame", "orders", "SELECT o_orderkey, sum(o_custkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS s FROM orders", "SELECT o_orderkey, CAST(sum(o_custkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS s FROM orders")
_sql("sql_window_range_frame", "orders", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey RANGE BETWEEN 100 PRECEDING AND 100 FOLLOWING) AS n FROM orders")
_sql("sql_union_all", _C_O, "SELECT c_custkey AS k FROM customer UNION ALL SELECT o_custkey AS k FROM orders")
for _name in ("union", "intersect", "except"):
    _sql(f"sql_{_name}", _C_O, f"SELECT c_custkey AS k FROM customer {_name.upper()} SELECT o_custkey AS k FROM orders")
_sql("sql_except_all", _C_O, "SELECT o_custkey AS k FROM orders EXCEPT ALL SELECT c_custkey AS k FROM customer")
_sql("sql_grouping_sets", "orders", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
for _name in ("cube", "rollup"):
    _sql(f"sql_{_name}", "orders", f"SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY {_name.upper()} (o_orderstatus, o_orderpriority)")
_sql("sql_cte", "lineitem", "WITH a AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey), b AS (SELECT max(n) AS m FROM a) SELECT l_suppkey, n FROM a, b WHERE n * 2 > m")
_sql("sql_scalar_subquery", "part", "SELECT p_partkey FROM part WHERE p_retailprice > (SELECT avg(p_retailprice) FROM part)")
_sql("sql_correlated", _C_O, "SELECT c_custkey, (SELECT max(o_orderkey) FROM orders WHERE o_custkey = c_custkey) AS last_order FROM customer")
_sql("sql_having", "lineitem", "SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey HAVING count(*) > 10")
_sql("sql_topk", "orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 20 OFFSET 5")
_sql("sql_except_columns", "nation", "SELECT * EXCEPT (n_name) FROM nation", "SELECT * EXCLUDE (n_name) FROM nation")
_sql("sql_string_fns", "part", "SELECT p_partkey, upper(p_brand) AS u, length(p_name) AS n, substring(p_name, 2, 3) AS s, concat_ws('|', p_brand, p_type) AS c, CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS k, coalesce(nullif(p_brand, 'Brand#11'), '-') AS f FROM part")
_sql("sql_date_fns", "orders", "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, CAST(date_trunc('month', o_orderdate) AS DATE) AS d, datediff(DATE '1999-01-01', CAST(o_orderdate AS DATE)) AS n FROM orders", "SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m, CAST(date_trunc('month', o_orderdate) AS DATE) AS d, CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '1999-01-01') AS INT) AS n FROM orders")
_sql("sql_math_fns", "part", "SELECT p_partkey, round(sqrt(p_retailprice), 6) AS r, p_partkey % 7 AS m, abs(p_size - 25) AS a, CAST(floor(p_retailprice) AS BIGINT) AS f, greatest(p_size, 10) AS g FROM part")
_sql("sql_array_fns", "embeddings", "SELECT vec_id, size(embedding) AS n, element_at(embedding, 1) AS x FROM embeddings", "SELECT vec_id, CAST(len(embedding) AS INT) AS n, embedding[1] AS x FROM embeddings")
_sql("sql_json_fns", "events", "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
_sql("sql_distinct", "customer", "SELECT DISTINCT c_mktsegment, c_nationkey FROM customer")
_sql("sql_tpch_q1", "lineitem", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP_NTZ '1998-09-02 00:00:00' GROUP BY 1, 2", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY 1, 2")


_sql("sql_intersect_all", _C_O, "SELECT o_custkey AS k FROM orders INTERSECT ALL SELECT c_custkey AS k FROM customer")
_sql("sql_window_share", "orders", "SELECT o_orderkey, round(percent_rank() OVER w, 9) AS p, round(cume_dist() OVER w, 9) AS c, last_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last, nth_value(o_orderkey, 2) OVER w AS second FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
# Groups of peers have no frame of their own in Spark: a range over their dense rank is the same.
_sql("sql_window_groups_frame", "orders", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY d RANGE BETWEEN 1 PRECEDING AND CURRENT ROW) AS n FROM (SELECT o_orderkey, o_custkey, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS d FROM orders)", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS n FROM orders")
_sql("sql_distinct_on", "orders", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n = 1", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
_sql("sql_statistics", "lineitem", "SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(var_pop(l_quantity), 6) AS v, round(corr(l_quantity, l_extendedprice), 6) AS c, median(l_quantity) AS m, count_if(l_discount > 0.05) AS n FROM lineitem GROUP BY l_returnflag")
_sql("sql_filtered_aggregate", "orders", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'O') AS opened, max(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS top FROM orders GROUP BY o_orderpriority")
_sql("sql_regex_fns", "part", "SELECT p_partkey, regexp_replace(p_brand, '[0-9]+', '#') AS r, regexp_extract(p_brand, '([0-9]+)', 1) AS d, p_name LIKE '%an%' AS l, lpad(p_brand, 10, '*') AS w, reverse(p_brand) AS b FROM part", "SELECT p_partkey, regexp_replace(p_brand, '[0-9]+', '#', 'g') AS r, regexp_extract(p_brand, '([0-9]+)', 1) AS d, p_name LIKE '%an%' AS l, lpad(p_brand, 10, '*') AS w, reverse(p_brand) AS b FROM part")
_sql("sql_intervals", "orders", "SELECT o_orderkey, CAST(o_orderdate + INTERVAL 1 MONTH AS DATE) AS due, CAST(last_day(o_orderdate) AS DATE) AS last, quarter(o_orderdate) AS q FROM orders", "SELECT o_orderkey, CAST(o_orderdate + INTERVAL 1 MONTH AS DATE) AS due, CAST(last_day(o_orderdate) AS DATE) AS last, CAST(quarter(o_orderdate) AS INT) AS q FROM orders")
_sql("sql_values", "nation", "SELECT n_name, v.label FROM nation JOIN (VALUES (0, 'first'), (1, 'second')) AS v(k, label) ON n_regionkey = v.k")
_sql("sql_lateral", _C_O, "SELECT c_custkey, t.n FROM customer, LATERAL (SELECT count(*) AS n FROM orders WHERE o_custkey = c_custkey) AS t")
_sql("sql_tpch_q3", "customer orders lineitem", "SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' GROUP BY l_orderkey ORDER BY revenue DESC, l_orderkey LIMIT 10")


# These go to the stage as they are: Spark's own grammar lacks the first two, and sorts nulls the other way.
_sql("sql_distinct_on_clause", "orders", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
_sql("sql_replace_columns", "nation", "SELECT * REPLACE (upper(n_name) AS n_name, n_nationkey + 100 AS n_nationkey) FROM nation WHERE n_regionkey < 3")
_sql("sql_order_nulls", _C_O, "SELECT c_custkey, o_orderkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY o_orderkey, c_custkey) AS up, row_number() OVER (PARTITION BY c_nationkey ORDER BY o_orderkey DESC, c_custkey) AS down FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 2000",
     "SELECT c_custkey, o_orderkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY o_orderkey ASC NULLS LAST, c_custkey) AS up, row_number() OVER (PARTITION BY c_nationkey ORDER BY o_orderkey DESC NULLS FIRST, c_custkey) AS down FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 2000")


# Sketches are near the exact counts rather than equal to them.
_sql("sql_approximate", "lineitem", "SELECT l_returnflag, abs(approx_count_distinct(l_partkey) - count(DISTINCT l_partkey)) <= 0.15 * count(DISTINCT l_partkey) AS n, abs(percentile_approx(l_extendedprice, 0.5, 1000) - median(l_extendedprice)) <= 0.02 * median(l_extendedprice) AS m FROM lineitem GROUP BY l_returnflag", "SELECT DISTINCT l_returnflag, true AS n, true AS m FROM lineitem")
_sql("sql_map_struct", "orders", "SELECT o_orderkey, map('key', o_custkey, 'one', 1)['key'] AS k, named_struct('s', o_orderstatus, 'c', o_custkey).s AS s, map_keys(map(o_orderpriority, 1))[0] AS p FROM orders", "SELECT o_orderkey, o_custkey AS k, struct_pack(s := o_orderstatus, c := o_custkey).s AS s, map_keys(MAP {o_orderpriority: 1})[1] AS p FROM orders")
_sql("sql_pivot", "orders", "SELECT * FROM (SELECT o_orderpriority, o_orderstatus FROM orders) PIVOT (count(*) FOR o_orderstatus IN ('O' AS o, 'F' AS f, 'P' AS p))", "SELECT o_orderpriority, nullif(count(*) FILTER (o_orderstatus = 'O'), 0) AS o, nullif(count(*) FILTER (o_orderstatus = 'F'), 0) AS f, nullif(count(*) FILTER (o_orderstatus = 'P'), 0) AS p FROM orders GROUP BY 1")


@query("sql_join_range", "SELECT event_id, o.o_orderkey FROM events e JOIN orders o ON e.user_id = o.o_custkey AND e.value BETWEEN o.o_totalprice / 100 - 5 AND o.o_totalprice / 100 + 5", "events", "orders")
def _range(events, orders):
    """A range join on an equal key: the equality deals rows, the range filters them."""
    due = F.col("o_totalprice") / 100
    return events.join(orders, (F.col("user_id") == F.col("o_custkey")) & F.col("value").between(due - 5, due + 5)).select("event_id", "o_orderkey")


@query("sql_join_asof", """WITH p AS (SELECT user_id, ts, arg_max(event_id, event_id) AS purchase_id, arg_max(value, event_id) AS amount FROM events WHERE event_type = 'purchase' GROUP BY user_id, ts)
    SELECT event_id, purchase_id, amount FROM events e ASOF LEFT JOIN p ON e.user_id = p.user_id AND e.ts > p.ts""", "events")
def _asof(events):
    """The user's last purchase before each event, with its value."""
    bought = events.filter("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("purchase_id"), F.col("value").alias("amount"))
    return joins.asof(events.select("event_id", "user_id", "ts"), bought, ["user_id"], "ts", ["purchase_id", "amount"], ["purchase_id"], strict=True).select("event_id", "purchase_id", "amount")


@query("sql_join_asof_inclusive", """WITH c AS (SELECT event_type, ts, arg_max(event_id, event_id) AS click FROM events WHERE user_id % 3 = 0 GROUP BY event_type, ts)
    SELECT event_id, click FROM events e ASOF LEFT JOIN c ON e.event_type = c.event_type AND e.ts >= c.ts""", "events")
def _asof_inclusive(events):
    """Few hot keys, whose rows are many tasks' work: the latest event of the same type, at the same time or before, of every third user."""
    third = events.filter("user_id % 3 = 0").select("event_type", "ts", F.col("event_id").alias("click"))
    return joins.asof(events.select("event_id", "event_type", "ts"), third, ["event_type"], "ts", ["click"], ["click"]).select("event_id", "click")


@query("sql_join_interval", """WITH c AS (SELECT c_custkey, c_acctbal - 2 AS a, c_acctbal + c_nationkey * 3 AS b FROM customer), s AS (SELECT s_suppkey, s_acctbal - 1 AS x, s_acctbal + CASE WHEN s_nationkey < 3 THEN 900 ELSE 5 END AS y FROM supplier)
    SELECT c_custkey, s_suppkey FROM c JOIN s ON a <= y AND x <= b""", "customer", "supplier")
def _interval(customer, supplier):
    """Ranges of balances that overlap, some of them long, without an equal key."""
    c = customer.select("c_custkey", (F.col("c_acctbal") - 2).alias("a"), (F.col("c_acctbal") + F.col("c_nationkey") * 3).alias("b"))
    s = supplier.select("s_suppkey", (F.col("s_acctbal") - 1).alias("x"), (F.col("s_acctbal") + F.when(F.col("s_nationkey") < 3, 900).otherwise(5)).alias("y"))
    return joins.intervals(c, s, ("a", "b"), ("x", "y")).select("c_custkey", "s_suppkey")


def _quality(name: str, column: str, check: dict, violations: str) -> None:
    sql = f"SELECT '{column}' AS \"column\", '{check['kind']}' AS \"check\", CASE WHEN {violations} > 0 THEN 'fail' ELSE 'pass' END AS status, CAST({violations} AS BIGINT) AS violation_count, count(*) AS sample_size FROM orders"
    query(name, sql, "orders")(lambda orders: quality.run_checks(orders, [{"column": column, "check": check}], examples=False).drop("message"))


_quality("dq_not_null", "o_custkey", {"kind": "not_null"}, "count(*) - count(o_custkey)")
_quality("dq_unique", "o_custkey", {"kind": "unique"}, "count(o_custkey) - count(DISTINCT o_custkey)")
_quality("dq_min", "o_totalprice", {"kind": "min", "min": 2000}, "count(*) FILTER (o_totalprice < 2000)")
_quality("dq_max", "o_totalprice", {"kind": "max", "max": 300000}, "count(*) FILTER (o_totalprice > 300000)")
_quality("dq_accepted_values", "o_orderstatus", {"kind": "accepted_values", "values": ["O", "F"]}, "count(*) FILTER (o_orderstatus NOT IN ('O', 'F'))")


@query("dq_row_count", "SELECT 'row_count' AS \"check\", 'pass' AS status, count(*) AS violation_count, count(*) AS sample_size FROM orders", "orders")
def _row_count(orders):
    return quality.run_checks(orders, [{"column": "", "check": {"kind": "row_count", "min": 1}}]).drop("message", "column")


@query("dq_unknown_column", "SELECT 'gone' AS \"column\", 'not_null' AS \"check\", 'fail' AS status, 'column gone not found' AS message, CAST(NULL AS BIGINT) AS violation_count, count(*) AS sample_size FROM orders", "orders")
def _unknown(orders):
    return quality.run_checks(orders, [{"column": "gone", "check": {"kind": "not_null"}}])


_INNER, _OUTER = (bytes(b ^ x for b in b"millrace".ljust(64, b"\0")).hex() for x in (0x36, 0x5C))


@query("mask_hmac", f"SELECT c_custkey, substr(sha256(unhex('{_OUTER}') || unhex(sha256(unhex('{_INNER}') || encode(c_name)))), 1, 32) AS c_name FROM customer", "customer")
def _mask(customer):
    return masking.mask(customer.select("c_custkey", "c_name"), ["c_name", "absent"], "millrace")


_CHANGES = "CASE WHEN event_type = 'purchase' THEN 'D' WHEN event_type = 'click' THEN 'U' ELSE 'I' END"


def _changes(events: DataFrame) -> DataFrame:
    code = F.when(F.col("event_type") == "purchase", "D").when(F.col("event_type") == "click", "U").otherwise("I")
    return events.select("event_id", "user_id", "value", code.alias(cdc.OPCODE))


@query("cdc_split_upserts", f"SELECT event_id, user_id, value FROM events WHERE {_CHANGES} <> 'D'", "events")
def _upserts(events):
    return cdc.split(_changes(events))[0]


@query("cdc_split_deletes", f"SELECT event_id, user_id, value FROM events WHERE {_CHANGES} = 'D'", "events")
def _deletes(events):
    return cdc.split(_changes(events))[1]


@query("cdc_latest_per_key", "SELECT DISTINCT ON (user_id) event_id, user_id, value FROM events ORDER BY user_id, event_id DESC", "events")
def _latest(events):
    return cdc.latest(events.select("event_id", "user_id", "value"), ["user_id"], ["event_id"])


@query("cdc_merge", f"""WITH ch AS (SELECT DISTINCT ON (user_id) user_id, value, {_CHANGES} AS op FROM events ORDER BY user_id, event_id DESC)
    SELECT c_custkey AS user_id, c_acctbal AS value FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM ch) UNION ALL SELECT user_id, value FROM ch WHERE op <> 'D'""", "events", "customer")
def _merge(events, customer):
    ch = cdc.latest(_changes(events), ["user_id"], ["event_id"]).drop("event_id")
    return cdc.merge(customer.select(F.col("c_custkey").alias("user_id"), F.col("c_acctbal").alias("value")), ch, ["user_id"])


@query("cdc_insert_if_absent", """WITH n AS (SELECT DISTINCT ON (user_id) user_id, value FROM events ORDER BY user_id, event_id DESC)
    SELECT c_custkey AS user_id, c_acctbal AS value FROM customer UNION ALL SELECT user_id, value FROM n WHERE user_id NOT IN (SELECT c_custkey FROM customer)""", "events", "customer")
def _absent(events, customer):
    new = cdc.latest(events.select("event_id", "user_id", "value"), ["user_id"], ["event_id"]).drop("event_id")
    return cdc.insert_if_absent(customer.select(F.col("c_custkey").alias("user_id"), F.col("c_acctbal").alias("value")), new, ["user_id"])


@query("cdc_map_change_feed", "SELECT event_id, CASE event_type WHEN 'purchase' THEN 'D' WHEN 'click' THEN 'U' ELSE 'I' END AS __opcode FROM events WHERE event_type <> 'view'", "events")
def _feed(events):
    kind = F.when(F.col("event_type") == "purchase", "delete").when(F.col("event_type") == "click", "update_postimage").when(F.col("event_type") == "view", "update_preimage").otherwise("insert")
    return cdc.from_change_feed(events.select("event_id", kind.alias("_change_type")))


@query("chunk_fixed", """SELECT doc_id, k AS chunk_index, substring(text, k * 400 + 1, 512) AS text FROM (SELECT doc_id, text, unnest(range(0, CAST(CASE WHEN length(text) <= 512 THEN 1 ELSE ceil((length(text) - 512) / 400) + 1 END AS BIGINT))) AS k FROM documents WHERE length(text) > 0)""", "documents")
def _chunks(documents):
    return textstages.chunk(documents.select("doc_id", "text"), "text", "fixed_window", 512, 112).withColumn("chunk_index", F.col("chunk_index").cast("long"))


@query("chunk_recursive", None, "documents")
def _recursive(documents):
    return textstages.chunk(documents.select("doc_id", "text"), "text", "recursive_character", 512, 64)


@query("chunk_semantic", None, "documents")
def _semantic(documents):
    return textstages.semantic_chunks(documents.select("doc_id", "text"), "text", 32, 0.1)


@query("chunk_fixed_overlap", """SELECT doc_id, count(*) AS n_chunks, CAST(sum(length(part)) AS BIGINT) AS chars FROM (SELECT doc_id, substring(text, k * 150 + 1, 200) AS part FROM (SELECT doc_id, text, unnest(range(0, CAST(CASE WHEN length(text) <= 200 THEN 1 ELSE ceil((length(text) - 200) / 150) + 1 END AS BIGINT))) AS k FROM documents WHERE length(text) > 0)) GROUP BY doc_id""", "documents")
def _overlap(documents):
    """Numbers and sizes of overlapping chunks."""
    parts = textstages.chunk(documents.select("doc_id", "text"), "text", "fixed_window", 200, 50)
    return parts.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.sum(F.length("text")).alias("chars"))


@query("sentences", r"""SELECT doc_id, CAST(len(list_filter(string_split(regexp_replace(text, '([.!?])(\s)', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: regexp_matches(x, '\S'))) AS INT) AS n_sentences FROM documents""", "documents")
def _sentences(documents):
    return documents.select("doc_id", F.size(tx.sentences(F.col("text"))).alias("n_sentences"))


@query("sentence_texts", r"""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])(\s)', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS s FROM documents)
    SELECT doc_id, CAST(unnest(generate_series(0, len(s) - 1)) AS INT) AS pos, unnest(s) AS sentence FROM s""", "documents")
def _sentence_texts(documents):
    """Every sentence, not only how many there are."""
    return documents.select("doc_id", F.posexplode(tx.sentences(F.col("text"))).alias("pos", "sentence"))


@query("embed", None, "documents")
def _embed(documents):
    return textstages.embed(documents.select("doc_id", "text"), "text", "vector", 16)


def _each(name: str, metric: str, distance: str) -> None:
    """All rows whose vec_id is divisible by 50 as queries, against all rows."""
    sql = f"""WITH q AS (SELECT vec_id AS query, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id % 50 = 0), d AS (SELECT query, vec_id, {distance} AS distance FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), q)
    SELECT query, vec_id, round(distance, 4) AS distance FROM d QUALIFY row_number() OVER (PARTITION BY query ORDER BY distance, vec_id) <= 10"""
    query(name, sql, "embeddings")(lambda embeddings: vectors.nearest_to_each(embeddings, embeddings.filter("vec_id % 50 = 0"), "vec_id", "embedding", 10, metric).withColumn("distance", F.round("distance", 4)))


for _name in ("topk", "topk_each"):  # two names of one search, which every row divisible by 50 asks
    _each(f"vec_l2_{_name}", "l2", "sqrt(list_sum(list_transform(list_zip(e, q), lambda p: (p[1] - p[2]) ** 2)))")
    _each(f"vec_cosine_{_name}", "cosine", "greatest(0.0, 1 - list_cosine_similarity(e, q))")


def _ivf(embeddings: DataFrame, metric: str) -> DataFrame:
    """query, vec_id, distance: approximate neighbours of every row divisible by 50 among all rows."""
    index = vectors.InvertedLists(embeddings, "vec_id", "embedding", scratch(embeddings.sparkSession, "lists"), metric)
    return index.search(embeddings.filter("vec_id % 50 = 0"), "embedding", 10)


def _recall(name: str, metric: str) -> None:
    """Whether nine in ten of the exact neighbours are found, and for how many queries; the neighbours themselves are ``vec_ivf_*_topk``."""

    def measured(embeddings):
        queries = embeddings.filter("vec_id % 50 = 0")
        exact = vectors.nearest_to_each(embeddings, queries, "vec_id", "embedding", 10, metric).select("query", "vec_id")
        met = exact.join(_ivf(embeddings, metric).select("query", "vec_id", F.lit(1).alias("hit")), ["query", "vec_id"], "left")
        return met.agg(F.count_distinct("query").alias("queries"), (F.coalesce(F.sum("hit"), F.lit(0)) >= 0.9 * F.count("*")).alias("met"))

    query(name, "SELECT count(*) AS queries, true AS met FROM embeddings WHERE vec_id % 50 = 0", "embeddings")(measured)


for _metric in ("l2", "cosine"):
    query(f"vec_ivf_{_metric}_topk", None, "embeddings")(lambda embeddings, m=_metric: _ivf(embeddings, m))
    _recall(f"vec_ivf_{_metric}_recall", _metric)


_TOKENS = r"list_distinct(list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> ''))"


@query("eval_jaccard_turns", f"""WITH t AS (SELECT conv_id, turn, {_TOKENS.format('text')} AS w FROM conversations), p AS (SELECT b.conv_id, b.turn, a.w AS a, b.w AS b, len(list_intersect(a.w, b.w)) AS n FROM t a JOIN t b ON a.conv_id = b.conv_id AND a.turn + 1 = b.turn)
    SELECT conv_id, turn, round(CASE WHEN len(a) + len(b) = 0 THEN 1.0 ELSE n / (len(a) + len(b) - n) END, 6) AS score FROM p""", "conversations")
def _jaccard_turns(conversations):
    """Every turn against the one before it in its conversation."""
    before = conversations.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("a"))
    now = conversations.select("conv_id", "turn", F.col("text").alias("b"))
    return before.join(now, ["conv_id", "turn"]).select("conv_id", "turn", F.round(tx.token_similarity(F.col("a"), F.col("b")), 6).alias("score"))


QUERIES["eval_jaccard"], ORACLE_SQL["eval_jaccard"] = QUERIES["eval_jaccard_turns"], ORACLE_SQL["eval_jaccard_turns"]


@query("prompt_build", "SELECT conv_id, turn, 'As ' || role || ': ' || text || ' {more}' AS prompt FROM conversations", "conversations")
def _prompt(conversations):
    return conversations.select("conv_id", "turn", tx.prompt("As {role}: {text} {more}", ["role", "text"]).alias("prompt"))


@query("llm_complete", "SELECT conv_id, turn, CAST(length(role || ': ' || text) AS VARCHAR) AS reply FROM conversations", "conversations")
def _complete(conversations):
    return textstages.complete(conversations, "{role}: {text}", ["role", "text"], "reply", lambda prompts: [len(p) for p in prompts]).select("conv_id", "turn", "reply")


_DAILY = "(SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2)"


@query("anomaly_zscore", f"""WITH d AS (SELECT *, count(n) OVER w AS p, avg(n) OVER w AS mu, stddev_pop(n) OVER w AS sd FROM {_DAILY} WINDOW w AS (PARTITION BY event_type ORDER BY day ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))
    SELECT event_type, day, n, CASE WHEN p < 5 THEN 'none' WHEN sd = 0 THEN CASE WHEN n = mu THEN 'none' ELSE 'warning' END WHEN abs(n - mu) / sd >= 3 THEN 'critical' WHEN abs(n - mu) / sd >= 2 THEN 'warning' ELSE 'none' END AS severity FROM d""", "events")
def _anomaly(events):
    daily = events.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return stats.anomalies(daily, ["event_type"], ["day"], "n").select("event_type", "day", "n", "severity")


@query("volume_trend", "SELECT * FROM (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1 ORDER BY 1 DESC LIMIT 50)", "events")
def _trend(events):
    return stats.trend(events.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n")), "day")


@query("bucket_avg", "SELECT CAST(floor((epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) / 3600000000) AS BIGINT) AS bucket, round(avg(value), 6) AS value FROM events GROUP BY 1", "events")
def _buckets(events):
    return stats.buckets(events, "ts", ["value"], 3600).withColumn("value", F.round("value", 6))


@query("pk_partitions", "WITH b AS (SELECT min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders) SELECT CAST((o_orderkey - lo) // ((hi - lo + 8) // 8) AS BIGINT) AS part, count(*) AS n FROM orders, b GROUP BY 1", "orders")
def _ranges(orders):
    part = F.lit(None).cast("long")
    for i, (a, _) in enumerate(stats.key_ranges(orders, "o_orderkey", 8)):
        part = F.when(F.col("o_orderkey") >= a, F.lit(i).cast("long")).otherwise(part)
    return orders.groupBy(part.alias("part")).agg(F.count("*").alias("n"))


@query("catalog_search", "SELECT p_partkey FROM part WHERE contains(lower(p_name), 'an') AND p_brand = 'Brand#11'", "part")
def _search(part):
    return stats.search(part, "AN", ["p_name"], {"p_brand": "Brand#11"}).select("p_partkey")


def _streamed(name: str, sql: str, f) -> None:
    query(name, sql, "events")(lambda events: f(events.select("event_type", F.col("ts").cast("timestamp_ntz").cast("timestamp").alias("ts"))).select(*[F.col(c).cast("timestamp_ntz").alias(c) if c in ("start", "end") else F.col(c) for c in ("start", "end", "event_type", "n")]))


_streamed("stream_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS \"end\", event_type, count(*) AS n FROM events GROUP BY ALL", lambda e: streams.tumbling(e, "ts", "1 hour", ["event_type"]))
_streamed("stream_sliding", "SELECT s AS start, s + INTERVAL 2 HOUR AS \"end\", event_type, count(*) AS n FROM (SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) - k * INTERVAL 1 HOUR AS s FROM events, range(0, 2) r(k)) GROUP BY ALL", lambda e: streams.tumbling(e, "ts", "2 hours", ["event_type"], slide="1 hour"))
_streamed("stream_session", """WITH a AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 10 MINUTE THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)),
    b AS (SELECT *, sum(new) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS s FROM a) SELECT min(ts) AS start, max(ts) + INTERVAL 10 MINUTE AS "end", event_type, count(*) AS n FROM b GROUP BY event_type, s""", lambda e: streams.sessions(e, "ts", "10 minutes", ["event_type"]))


@query("json_infer", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events", "events")
def _json(events):
    """A JSON column typed by its first rows, parsed over all."""
    import json

    first = [json.loads(r.props) for r in events.filter("props IS NOT NULL").select("props").limit(1000).collect()]
    schema = registry.infer_json(first) or "k bigint"
    return events.select("event_id", F.from_json("props", schema).alias("p")).select("event_id", "p.*")


QUERIES["stream_cdc_mirror"] = lambda spark, sf_dir: _mirrored(spark, sf_dir)
ORACLE_SQL["stream_cdc_mirror"] = f"SELECT user_id, value FROM (SELECT DISTINCT ON (user_id) user_id, value, {_CHANGES} AS op FROM events ORDER BY user_id, event_id DESC) WHERE op <> 'D'"


def _mirrored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of changes into a mirror, run until all of it is there."""
    like = table(spark, sf_dir, "events")
    changes = _changes(streams.files(spark, f"{sf_dir}/event[s].parquet", like))  # a pattern, as a stream's path is no single file
    target = scratch(spark, "mirror")
    streams.mirror(changes, target, ["user_id"], scratch(spark, "offsets"), ["event_id"]).awaitTermination()
    return keyed.read(spark, target).select("user_id", "value")


@query("stream_running_totals", "SELECT user_id, count(*) AS n, round(sum(value), 4) AS total, max(ts) AS last FROM events GROUP BY user_id", "events")
def _running(events):
    """Totals by user, kept over triggers of a stream that stops half-way and goes on: the events in four files, a file a trigger."""
    spark = events.sparkSession
    source, target, offsets = (scratch(spark, x) for x in ("events", "totals", "offsets"))
    parts = events.select("user_id", "value", F.col("ts").cast("timestamp_ntz").cast("timestamp").alias("ts"), (F.col("event_id") % 4).alias("part")).persist()
    try:
        for some in ((0, 1), (2, 3)):  # the second run finds the first one's state
            for k in some:
                parts.filter(F.col("part") == k).drop("part").coalesce(1).write.mode("append").parquet(source)
            stream = streams.files(spark, source, parts.drop("part"))
            totals.keep(stream, target, ["user_id"], offsets, values=["value"], ts="ts").awaitTermination()
    finally:
        parts.unpersist()
    return keyed.read(spark, target).select("user_id", "n", F.round("sum_value", 4).alias("total"), F.col("last").cast("timestamp_ntz").alias("last"))
