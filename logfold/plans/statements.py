"""Named queries written in SQLite's SQL and run through the translator, with the SQL that checks each in DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from logfold import dialect
from logfold.operators import joins
from logfold.plans.catalog import ORACLES, QUERIES, query, table
from logfold.query import kind_of

_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A statement over the tables that it names."""
    frames = {n: table(spark, sf_dir, n) for n in _TABLES if re.search(rf"\b{n}\b", sql)}
    for name, df in frames.items():
        df.createOrReplaceTempView(name)
    kinds = {n: {f.name: kind_of(f.dataType.simpleString()) for f in df.schema} for n, df in frames.items()}
    return spark.sql(dialect.translate(sql, lambda n: kinds.get(n.lower())))


def statement(name: str, sql: str, oracle: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: run(spark, sf_dir, sql)
    ORACLES[name] = oracle


def _int(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


statement(
    "sql_arith",
    "SELECT o_orderkey, o_orderkey / 7 AS q, o_orderkey % 7 AS r, o_custkey / (o_orderkey % 3) AS z, o_totalprice / 2 AS h, -o_orderkey / 4 AS neg, 7 / 2 AS k, o_orderkey & 6 AS bits, o_orderkey << 2 AS sh, '3x' + o_orderkey AS lead, o_totalprice / 0 AS none FROM orders",
    f"SELECT o_orderkey, {_int('trunc(o_orderkey / 7)')} AS q, o_orderkey % 7 AS r, {_int('trunc(o_custkey / nullif(o_orderkey % 3, 0))')} AS z, o_totalprice / 2 AS h, {_int('trunc(-o_orderkey / 4)')} AS neg, {_int(3)} AS k, o_orderkey & 6 AS bits, o_orderkey * 4 AS sh, 3 + o_orderkey AS lead, CAST(NULL AS DOUBLE) AS none FROM orders",
)
statement(
    "sql_compare",
    "SELECT c_custkey, c_custkey = '5' AS a, c_mktsegment > 5 AS b, c_acctbal > 1000 AS c, c_custkey IN (1, '2') AS d, 1 = '1' AS e, c_mktsegment LIKE 'auto%' AS f, c_mktsegment GLOB 'A*' AS g, c_acctbal BETWEEN 0 AND 100 AS h, c_custkey IS NOT 3 AS i, NOT c_custkey AS j, 'a' < x'61' AS k, c_name = 'CUSTOMER#000000001' COLLATE NOCASE AS l FROM customer",
    "SELECT c_custkey, " + ", ".join(f"{_int(x)} AS {n}" for n, x in zip("abcdefghijkl", ("c_custkey = 5", "c_mktsegment > '5'", "c_acctbal > 1000", "c_custkey IN (1, 2)", "0", "c_mktsegment ILIKE 'auto%'", "c_mktsegment LIKE 'A%'", "c_acctbal BETWEEN 0 AND 100", "c_custkey <> 3", "c_custkey = 0", "1", "lower(c_name) = 'customer#000000001'"))) + " FROM customer",
)
_D = "CAST(o_orderdate AS TEXT)"
statement(
    "sql_dates",
    f"SELECT o_orderkey, date({_D}, '+1 month') AS m, strftime('%Y-%j %w', {_D}) AS yj, datetime({_D}, '-90 minutes') AS dt, unixepoch({_D}) AS u, julianday({_D}) AS jd, date({_D}, 'start of year', '+1 year', '-1 day') AS last, time({_D}) AS t, date('x') AS none FROM orders",
    "SELECT o_orderkey, strftime(CAST(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH AS DATE) + CAST(day(o_orderdate) - 1 AS INTEGER), '%Y-%m-%d') AS m, strftime(o_orderdate, '%Y-%j %w') AS yj, strftime(o_orderdate - INTERVAL 90 MINUTE, '%Y-%m-%d %H:%M:%S') AS dt, CAST(epoch_us(o_orderdate) // 1000000 AS BIGINT) AS u, epoch_us(o_orderdate) / 86400000000.0::DOUBLE + 2440587.5::DOUBLE AS jd, strftime(make_date(year(o_orderdate), 12, 31), '%Y-%m-%d') AS last, strftime(o_orderdate, '%H:%M:%S') AS t, CAST(NULL AS VARCHAR) AS none FROM orders",
)
statement("intersect", "SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0", "SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
statement(
    "setops_chain",
    "SELECT n_nationkey AS k FROM nation UNION SELECT 99 INTERSECT SELECT r_regionkey FROM region",
    "(SELECT CAST(n_nationkey AS BIGINT) AS k FROM nation UNION SELECT 99) INTERSECT SELECT r_regionkey FROM region",
)
statement("limit_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20, 10", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 20")
statement("cross_join", "SELECT r_name, n_name FROM region CROSS JOIN nation", "SELECT r_name, n_name FROM region CROSS JOIN nation")
_N = "(SELECT r_regionkey AS k, r_name FROM region) AS a NATURAL JOIN (SELECT n_regionkey AS k, n_name FROM nation) AS b"
statement("natural_join", f"SELECT k, r_name, n_name FROM {_N}", f"SELECT k, r_name, n_name FROM {_N}")
_J = "(SELECT c_nationkey AS k, count(*) AS customers FROM customer WHERE c_custkey % 5 = 0 GROUP BY c_nationkey) AS a {} JOIN (SELECT s_nationkey AS k, count(*) AS suppliers FROM supplier GROUP BY s_nationkey) AS b USING (k)"
statement("full_join", f"SELECT k, customers, suppliers FROM {_J.format('FULL')}", f"SELECT k, customers, suppliers FROM {_J.format('FULL')}")
statement("right_join", f"SELECT k, customers, suppliers FROM {_J.format('RIGHT')}", f"SELECT k, customers, suppliers FROM {_J.format('RIGHT')}")
statement("exists_join", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
statement("bare_max", "SELECT o_custkey, max(o_totalprice) AS most, o_orderkey FROM orders GROUP BY o_custkey", "SELECT o_custkey, max(o_totalprice) AS most, arg_max(o_orderkey, o_totalprice) AS o_orderkey FROM orders GROUP BY o_custkey")
statement("group_concat", "SELECT n_regionkey, group_concat(n_name, '|') AS names, json_group_array(n_nationkey) AS keys FROM (SELECT * FROM nation ORDER BY n_name DESC) GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, '|' ORDER BY n_name DESC) AS names, '[' || string_agg(CAST(n_nationkey AS VARCHAR), ',' ORDER BY n_name DESC) || ']' AS keys FROM nation GROUP BY n_regionkey")
statement(
    "json_ops",
    "SELECT event_id, props ->> '$.k' AS k, props -> 'k' AS j, json_type(props, '$.k') AS t, json_type(props) AS o, json_valid(props) AS v, json_valid('{') AS w, json_object('id', event_id, 'u', event_type) AS made, json_array(event_id, NULL, 'a') AS arr, json_array_length('[1,2,3]') AS n FROM events",
    f"""SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(json_extract(props, '$.k') AS VARCHAR) AS j, 'integer' AS t, 'object' AS o, {_int(1)} AS v, {_int(0)} AS w, '{{"id":' || event_id || ',"u":"' || event_type || '"}}' AS made, '[' || event_id || ',null,"a"]' AS arr, {_int(3)} AS n FROM events""",
)
statement(
    "window_frames",
    "SELECT event_id, last_value(event_type) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last, count(*) OVER (PARTITION BY user_id ORDER BY event_id RANGE BETWEEN 500 PRECEDING AND CURRENT ROW) AS near, max(value) OVER w AS top, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id)",
    "SELECT event_id, last_value(event_type) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last, count(*) OVER (PARTITION BY user_id ORDER BY event_id RANGE BETWEEN 500 PRECEDING AND CURRENT ROW) AS near, max(value) OVER w AS top, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id)",
)
statement(
    "string_suite",
    "SELECT c_custkey, quote(c_name) AS q, unicode(c_name) AS u, char(65, 233) AS c, ltrim(c_name, 'C') AS l, rtrim(c_name, '0123456789') AS r, printf('%05d/%s', c_custkey, c_mktsegment) AS p, substr(c_name, -3) AS tail, substr(c_name, 0, 3) AS head, typeof(c_name) AS t, typeof(c_acctbal) AS tf, typeof(c_custkey) AS ti, iif(c_acctbal > 0, 'credit', 'debit') AS side, c_custkey || ':' || c_mktsegment AS joined, length(c_custkey) AS len FROM customer",
    "SELECT c_custkey, '''' || c_name || '''' AS q, CAST(unicode(c_name) AS BIGINT) AS u, 'Aé' AS c, ltrim(c_name, 'C') AS l, rtrim(c_name, '0123456789') AS r, printf('%05d/%s', c_custkey, c_mktsegment) AS p, right(c_name, 3) AS tail, left(c_name, 2) AS head, 'text' AS t, 'real' AS tf, 'integer' AS ti, CASE WHEN c_acctbal > 0 THEN 'credit' ELSE 'debit' END AS side, c_custkey || ':' || c_mktsegment AS joined, length(CAST(c_custkey AS VARCHAR)) AS len FROM customer",
)
statement(
    "math_suite",
    "SELECT p_partkey, round(sqrt(p_retailprice), 6) AS s, round(ln(p_retailprice), 6) AS l, round(pow(p_size, 1.5), 6) AS p, ceil(p_retailprice) AS c, floor(-p_retailprice) AS f, sign(p_size - 25) AS g, max(p_size, 25) AS hi, min(p_size, 25, 7) AS lo, abs(p_size - 25) AS a, round(p_retailprice, 1) AS r, round(sin(p_size), 6) AS n, CAST(p_retailprice AS INTEGER) AS i, total(1) OVER () AS t FROM part",
    f"SELECT p_partkey, round(sqrt(p_retailprice), 6) AS s, round(ln(p_retailprice), 6) AS l, round(pow(p_size, 1.5), 6) AS p, ceil(p_retailprice) AS c, floor(-p_retailprice) AS f, {_int('sign(p_size - 25)')} AS g, {_int('greatest(p_size, 25)')} AS hi, {_int('least(p_size, 25, 7)')} AS lo, {_int('abs(p_size - 25)')} AS a, round(p_retailprice, 1) AS r, round(sin(p_size), 6) AS n, {_int('trunc(p_retailprice)')} AS i, CAST(count(*) OVER () AS DOUBLE) AS t FROM part",
)
statement(
    "blob_suite",
    "SELECT n_nationkey, hex(CAST(n_name AS BLOB)) AS h, length(CAST(n_name AS BLOB)) AS n, hex(zeroblob(3)) AS z, hex(x'ff00') AS x, typeof(x'ff00') AS t, hex(substr(CAST(n_name AS BLOB), 2, 2)) AS s FROM nation",
    f"SELECT n_nationkey, hex(n_name) AS h, {_int('strlen(n_name)')} AS n, '000000' AS z, 'FF00' AS x, 'blob' AS t, hex(substr(n_name, 2, 2)) AS s FROM nation",
)
statement("row_values", "SELECT o_orderkey FROM orders WHERE (o_custkey, o_orderstatus) IN (SELECT c_custkey, 'F' FROM customer WHERE c_acctbal < 0) AND o_custkey IS DISTINCT FROM 7", "SELECT o_orderkey FROM orders WHERE (o_custkey, o_orderstatus) IN (SELECT (c_custkey, 'F') FROM customer WHERE c_acctbal < 0) AND o_custkey IS DISTINCT FROM 7")


@query("SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_acctbal >= s_acctbal AND c_acctbal < s_acctbal + 50")
def range_join(spark, sf_dir):
    """Each customer with the suppliers whose range its balance falls into, by bins instead of a nested loop."""
    ranges = table(spark, sf_dir, "supplier").selectExpr("s_suppkey", "s_acctbal AS low", "s_acctbal + 50 AS high")
    return joins.range_join(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), ranges, "c_acctbal", "low", "high").select("c_custkey", "s_suppkey")
