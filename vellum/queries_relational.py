"""Relational SQL over the same tables, as views of a session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vellum.registering import Entry
from vellum.sources import tables

QUERIES: dict[str, Entry] = {}


def run_sql(spark: SparkSession, sf_dir: str, names: tuple[str, ...], text: str) -> DataFrame:
    """Spark SQL over the named tables, passed as parameters and not registered under shared names."""
    return spark.sql(text.format(**{n: "{" + n + "}" for n in names}), **{n: tables.table(spark, sf_dir, n) for n in names})


def _add(name: str, names: str, text: str, duck: str | None = None) -> None:
    used = tuple(names.split())
    QUERIES[name] = Entry(lambda spark, sf_dir: run_sql(spark, sf_dir, used, text), duck or text.format(**{n: n for n in used}))


_CENTS = "CAST(round({0} * 100) AS BIGINT)"
_BAL = _CENTS.format("c_acctbal")

_add("sql_agg_where", "customer", f"SELECT count(*) AS n, CAST(sum({_BAL}) AS BIGINT) AS cents, CAST(sum({_BAL}) AS DOUBLE) / count(*) AS mean_cents FROM {{customer}} WHERE c_acctbal > 50")
_add("sql_scalar_subquery", "customer", "SELECT c_custkey, c_name, c_acctbal FROM {customer} WHERE c_acctbal = (SELECT max(c_acctbal) FROM {customer})")
_add("sql_point_select", "customer", "SELECT c_custkey, c_name, c_mktsegment FROM {customer} WHERE c_custkey = 42")
_add("sql_update_project", "customer", f"SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN {_BAL} + 1000 ELSE {_BAL} END AS cents, c_mktsegment = 'BUILDING' AS updated FROM {{customer}}")
_add("sql_delete_count", "customer", "SELECT count(*) AS deleted, (SELECT count(*) FROM {customer}) - count(*) AS kept FROM {customer} WHERE c_acctbal < 0")
_add("sql_mass_conservation", "customer", f"SELECT (SELECT CAST(sum({_BAL}) AS BIGINT) FROM {{customer}}) = CAST(sum(CASE WHEN c_custkey = 1 THEN {_BAL} - 500 WHEN c_custkey = 2 THEN {_BAL} + 500 ELSE {_BAL} END) AS BIGINT) AS conserved FROM {{customer}}")
_add("sql_join_agg", "customer orders nation", f"SELECT n_name, count(*) AS orders, CAST(sum({_CENTS.format('o_totalprice')}) AS BIGINT) AS cents FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey JOIN {{nation}} ON c_nationkey = n_nationkey GROUP BY n_name")
_add("sql_semi_join", "customer orders", "SELECT c_custkey, c_name FROM {customer} WHERE EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
_add("sql_anti_join", "customer orders", "SELECT c_custkey, c_name FROM {customer} WHERE NOT EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey)")
_add("sql_left_join", "customer orders", "SELECT c_custkey, count(o_orderkey) AS orders FROM {customer} LEFT JOIN {orders} ON o_custkey = c_custkey GROUP BY c_custkey")
_add("sql_full_join", "customer supplier", "SELECT coalesce(c_nationkey, s_nationkey) AS nation, c, s FROM (SELECT c_nationkey, count(*) AS c FROM {customer} GROUP BY c_nationkey) a FULL JOIN (SELECT s_nationkey, count(*) AS s FROM {supplier} GROUP BY s_nationkey) b ON c_nationkey = s_nationkey")
_add("sql_window_rank", "orders", "SELECT o_custkey, o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rnk, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev FROM {orders}")
_add("sql_set_ops", "customer orders", "SELECT c_custkey AS k FROM {customer} EXCEPT SELECT o_custkey FROM {orders} UNION SELECT o_custkey FROM {orders} WHERE o_orderstatus = 'P'")
_add("sql_intersect", "customer supplier", "SELECT c_nationkey AS k FROM {customer} INTERSECT SELECT s_nationkey FROM {supplier}")
_add("sql_grouping_sets", "orders", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), ())")
_add("sql_rollup", "lineitem", "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty FROM {lineitem} GROUP BY ROLLUP (l_returnflag, l_linestatus)")
_add("sql_cte", "orders", "WITH big AS (SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey) SELECT n, count(*) AS customers FROM big GROUP BY n")
_add("sql_recursive_cte", "nation", "WITH RECURSIVE r(k, depth) AS (SELECT n_nationkey, 0 FROM {nation} WHERE n_nationkey = 0 UNION ALL SELECT n_nationkey, depth + 1 FROM r JOIN {nation} ON (n_nationkey - 1) DIV 2 = k AND n_nationkey > 0) SELECT k, depth FROM r", "WITH RECURSIVE r(k, depth) AS (SELECT n_nationkey, 0 FROM nation WHERE n_nationkey = 0 UNION ALL SELECT n_nationkey, depth + 1 FROM r JOIN nation ON (n_nationkey - 1) // 2 = k AND n_nationkey > 0) SELECT k, depth FROM r")
_add("sql_distinct_agg", "lineitem", "SELECT l_suppkey, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_orderkey) AS orders FROM {lineitem} GROUP BY l_suppkey")
_add("sql_having_in", "part lineitem", "SELECT p_brand, count(*) AS n FROM {part} WHERE p_partkey IN (SELECT l_partkey FROM {lineitem} WHERE l_quantity >= 45) GROUP BY p_brand HAVING count(*) > 2")
_add("sql_pricing_summary", "lineitem", f"SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty, CAST(sum({_CENTS.format('l_extendedprice')}) AS BIGINT) AS cents, CAST(sum({_CENTS.format('l_extendedprice')} * (100 - {_CENTS.format('l_discount')})) AS BIGINT) AS discounted, count(*) AS n FROM {{lineitem}} WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus")
_add("sql_table_info", "customer", "SELECT 0", "SELECT column_name AS name, CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' ELSE 'string' END AS type FROM (DESCRIBE customer)")
QUERIES["sql_table_info"] = Entry(lambda spark, sf_dir: spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in tables.table(spark, sf_dir, "customer").schema], "name string, type string"), QUERIES["sql_table_info"].sql)
_add("sql_cube", "orders", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY CUBE (o_orderstatus, o_orderpriority)")
_add("sql_pivot", "orders", "SELECT * FROM (SELECT o_orderpriority, o_orderstatus, o_orderkey FROM {orders}) PIVOT (count(o_orderkey) FOR o_orderstatus IN ('F' AS f, 'O' AS o, 'P' AS p))", "SELECT o_orderpriority, nullif(count(*) FILTER (o_orderstatus = 'F'), 0) AS f, nullif(count(*) FILTER (o_orderstatus = 'O'), 0) AS o, nullif(count(*) FILTER (o_orderstatus = 'P'), 0) AS p FROM orders GROUP BY o_orderpriority")
_add("sql_percentiles", "lineitem", "SELECT l_returnflag, CAST(percentile(l_quantity, 0.5) AS DOUBLE) AS p50, CAST(percentile(l_quantity, 0.9) AS DOUBLE) AS p90 FROM {lineitem} GROUP BY l_returnflag", "SELECT l_returnflag, CAST(quantile_cont(l_quantity, 0.5) AS DOUBLE) AS p50, CAST(quantile_cont(l_quantity, 0.9) AS DOUBLE) AS p90 FROM lineitem GROUP BY l_returnflag")
_add("sql_stddev", "lineitem", "SELECT l_returnflag, CAST(round(stddev_samp(l_quantity) * 1000) AS BIGINT) AS dev, CAST(round(var_pop(l_quantity) * 1000) AS BIGINT) AS var FROM {lineitem} GROUP BY l_returnflag")
