"""The relational surface of the dialect as executable operators.

Each entry is Spark SQL over the driver's tables, with the SQL that checks it where its text must differ
(None: the same text). Catalyst plans them: filters and columns reach the scans, joins are chosen from sizes.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlsift.functions.jsons import json_contained, json_contains, json_delete_path, json_has, json_path, json_without
from sqlsift.session import shared_dir

SQL: dict[str, tuple[str, str | None]] = {
    # projection, filters, distinct
    "proj_filter_alias": ("SELECT l_orderkey AS ok, l_linenumber AS ln, l_quantity * 2 AS dq FROM lineitem AS l WHERE l.l_quantity > 45 AND l_shipdate >= TIMESTAMP '1996-01-01 00:00:00'", None),
    "star": ("SELECT n.* FROM nation n", None),
    "empty_projection": ("SELECT count(*) AS n FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)", None),
    "distinct": ("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem", None),
    # joins
    "join_inner": ("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT'", None),
    "join_left": ("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000", None),
    "join_right": ("SELECT c_custkey, o_orderkey FROM orders RIGHT JOIN customer ON c_custkey = o_custkey AND o_totalprice > 300000", None),
    "join_full": ("SELECT n_nationkey, s_suppkey FROM nation FULL JOIN supplier ON n_nationkey = s_nationkey AND s_acctbal > 5000", None),
    "join_cross": ("SELECT n_name, r_name FROM nation CROSS JOIN region", None),
    "join_comma": ("SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey", None),
    "join_theta": ("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey > r_regionkey", None),
    "join_using": ("SELECT k, n_name, s_name FROM (SELECT n_nationkey AS k, n_name FROM nation) a JOIN (SELECT s_nationkey AS k, s_name FROM supplier) b USING (k)", None),
    "join_lateral": ("SELECT n_name, x.s_name FROM nation, LATERAL (SELECT s_name FROM supplier WHERE s_nationkey = n_nationkey) x", None),
    "semi_exists": ("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)", None),
    "semi_in": ("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')", None),
    "anti_not_exists": ("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)", None),
    # IN and NOT IN as an equality join and a count of the set's rows: as they stand, nulls make them a loop over all pairs or a broadcast of the whole set
    "anti_not_in": ("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AND (c_custkey IS NOT NULL OR (SELECT count(o_custkey) FROM orders) = 0)", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)"),
    "anti_invariant": (
        "SELECT count_if(has) AS semi, count_if(NOT has) AS anti, count(*) AS total FROM (SELECT CASE WHEN met THEN true WHEN n = 0 OR c_custkey IS NOT NULL AND n = named THEN false END AS has"
        " FROM (SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS met FROM customer) CROSS JOIN (SELECT count(*) AS n, count(o_custkey) AS named FROM orders))",
        "SELECT cast(count_if(has) AS BIGINT) AS semi, cast(count_if(NOT has) AS BIGINT) AS anti, count(*) AS total FROM (SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders) AS has FROM customer)",
    ),
    "scalar_subquery": ("SELECT o_orderkey FROM orders WHERE o_totalprice = (SELECT max(o_totalprice) FROM orders)", None),
    "correlated_subquery": ("SELECT o_orderkey FROM orders o WHERE o_totalprice > (SELECT 1.5 * avg(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)", None),
    "derived_table": ("SELECT avg_n FROM (SELECT round(avg(n), 6) AS avg_n FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey) x) y", None),
    # aggregation
    "group_having": ("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12", None),
    "agg_distinct": ("SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, count(ALL l_suppkey) AS n FROM lineitem GROUP BY l_returnflag", None),
    "agg_filter": ("SELECT l_returnflag, count(*) FILTER (WHERE l_quantity > 25) AS big, round(sum(l_quantity) FILTER (WHERE l_discount > 0.05), 2) AS q FROM lineitem GROUP BY l_returnflag", None),
    "agg_ordered": ("SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey"),
    "agg_basic": ("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice), 2) AS total, round(avg(l_quantity), 6) AS avg_q, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship FROM lineitem GROUP BY l_returnflag, l_linestatus", None),
    "rollup": ("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)", None),
    "cube": ("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)", None),
    # windows
    "window_partition": ("SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders", None),
    "window_order": ("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders", "SELECT o_orderkey, cast(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INT) AS rn FROM orders"),
    "window_named": ("SELECT o_orderkey, min(o_orderkey) OVER w AS first_key FROM orders WINDOW w AS (PARTITION BY o_custkey)", None),
    "window_rank": ("SELECT s_suppkey, rank() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC) AS r, dense_rank() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC) AS d, ntile(3) OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS t FROM supplier", "SELECT s_suppkey, cast(rank() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC) AS INT) AS r, cast(dense_rank() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC) AS INT) AS d, cast(ntile(3) OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS INT) AS t FROM supplier"),
    "window_lag": ("SELECT event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after FROM events", None),
    "window_frame": ("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS n FROM events", None),
    # order and limits
    "sort_nulls": ("SELECT k, v FROM (SELECT n_nationkey AS k, CASE WHEN n_regionkey > 1 THEN n_name END AS v FROM nation) ORDER BY v ASC NULLS LAST, k DESC NULLS FIRST", None),
    "limit_offset": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5", None),
    "fetch_first": ("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 7", "SELECT o_orderkey FROM orders ORDER BY o_orderkey FETCH FIRST 7 ROWS ONLY"),
    "fetch_with_ties": ("SELECT p_partkey, p_size FROM part WHERE p_size >= (SELECT min(p_size) FROM (SELECT p_size FROM part ORDER BY p_size DESC LIMIT 5))", "SELECT p_partkey, p_size FROM (SELECT p_partkey, p_size, rank() OVER (ORDER BY p_size DESC) AS r FROM part) WHERE r <= 5"),
    # set operations
    "union": ("SELECT n_nationkey AS k FROM nation UNION SELECT s_nationkey FROM supplier", None),
    "union_all": ("SELECT n_nationkey AS k FROM nation UNION ALL SELECT s_nationkey FROM supplier", None),
    "intersect": ("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier", None),
    "intersect_all": ("SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier", None),
    "except": ("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders", None),
    "except_all": ("SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier", None),
    "cte": ("WITH a AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey), b AS (SELECT max(n) AS m FROM a) SELECT o_custkey, n FROM a, b WHERE n = m", None),
    "cte_nested": ("SELECT * FROM (WITH x AS (SELECT r_regionkey AS k, r_name FROM region) SELECT k, r_name FROM x) y", None),
    "cte_recursive": (
        "WITH RECURSIVE t(k, depth) AS (SELECT c_custkey, 0 FROM customer WHERE c_custkey = 1 UNION ALL SELECT c.c_custkey, depth + 1 FROM t JOIN customer c ON c.c_custkey DIV 2 = t.k AND c.c_custkey > 1) SELECT depth, count(*) AS n, cast(sum(k) AS BIGINT) AS keys FROM t GROUP BY depth",
        "WITH RECURSIVE t(k, depth) AS (SELECT c_custkey, 0 FROM customer WHERE c_custkey = 1 UNION ALL SELECT c.c_custkey, depth + 1 FROM t JOIN customer c ON c.c_custkey // 2 = t.k AND c.c_custkey > 1) SELECT depth, count(*) AS n, cast(sum(k) AS BIGINT) AS keys FROM t GROUP BY depth",
    ),
    "values_table": ("SELECT n_name, a, b FROM nation JOIN (VALUES (0, 'x'), (1, 'y'), (3, NULL)) AS v(a, b) ON a = n_regionkey", None),
    "series": (
        "SELECT l_orderkey, l_linenumber, cast(i AS BIGINT) AS i FROM lineitem LATERAL VIEW explode(sequence(1, l_linenumber)) x AS i",
        "SELECT l_orderkey, l_linenumber, cast(i AS BIGINT) AS i FROM lineitem, LATERAL (SELECT unnest(generate_series(1, l_linenumber)) AS i) x",
    ),
    "ordinality": ("SELECT n_nationkey, cast(pos + 1 AS BIGINT) AS ord, w FROM nation LATERAL VIEW posexplode(split(n_name, ' ')) x AS pos, w", "SELECT n_nationkey, unnest(range(1, len(string_split(n_name, ' ')) + 1)) AS ord, unnest(string_split(n_name, ' ')) AS w FROM nation"),
    # scalar expressions
    "expr_literals": ("SELECT 1 AS i, 'a' AS s, true AS b, cast(NULL AS INT) AS n, cast(1.5 AS DOUBLE) AS d FROM region", None),
    "expr_arith": ("SELECT l_orderkey, l_linenumber, l_linenumber + 1 AS a, l_linenumber - 3 AS s, l_linenumber * 2 AS m, l_orderkey % 7 AS r, -l_linenumber AS neg, l_orderkey div 4 AS q FROM lineitem", "SELECT l_orderkey, l_linenumber, l_linenumber + 1 AS a, l_linenumber - 3 AS s, l_linenumber * 2 AS m, l_orderkey % 7 AS r, -l_linenumber AS neg, l_orderkey // 4 AS q FROM lineitem"),
    "expr_compare": ("SELECT o_orderkey FROM orders WHERE o_orderkey >= 10 AND o_orderkey <> 12 AND o_orderkey != 13 AND o_orderkey < 40", None),
    "expr_bool": ("SELECT o_orderkey, (o_orderkey > 5 AND NOT o_orderstatus = 'F') OR o_totalprice < 1000 AS b FROM orders", None),
    "expr_between_in": ("SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 1000 AND 50000 AND o_orderkey NOT BETWEEN 5 AND 9 AND o_orderstatus IN ('F', 'O') AND o_orderpriority NOT IN ('5-LOW')", None),
    "expr_tuple_in": ("SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_orderkey, l_linenumber) IN ((1L, 1), (2L, 1), (3L, 2))", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_orderkey, l_linenumber) IN ((1, 1), (2, 1), (3, 2))"),
    "expr_case": ("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 0 END AS s, CASE WHEN o_totalprice > 100000 THEN 'high' WHEN o_totalprice > 10000 THEN 'mid' END AS p FROM orders", None),
    "expr_cast": ("SELECT o_orderkey, cast(o_orderkey AS STRING) AS s, o_totalprice::DECIMAL(12,2) AS d, cast(o_orderdate AS DATE) AS dt, try_cast(o_orderpriority AS INT) AS bad FROM orders", "SELECT o_orderkey, cast(o_orderkey AS VARCHAR) AS s, o_totalprice::DECIMAL(12,2) AS d, cast(o_orderdate AS DATE) AS dt, try_cast(o_orderpriority AS INT) AS bad FROM orders"),
    "expr_is": ("SELECT k, v IS NULL AS a, v IS NOT NULL AS b, (v = 'X') IS TRUE AS c, (v = 'X') IS NOT TRUE AS d FROM (SELECT n_nationkey AS k, CASE WHEN n_regionkey > 1 THEN n_name END AS v FROM nation)", None),
    "expr_is_distinct": ("SELECT k FROM (SELECT n_nationkey AS k, CASE WHEN n_regionkey > 1 THEN n_regionkey END AS v FROM nation) WHERE v IS DISTINCT FROM 2 AND v IS NOT DISTINCT FROM NULL", None),
    "expr_like": ("SELECT p_partkey FROM part WHERE p_name LIKE '%a%' AND p_brand ILIKE 'brand%' AND p_type NOT LIKE 'Z%'", None),
    "expr_regex": ("SELECT p_partkey FROM part WHERE p_brand RLIKE '#[13]' AND p_name RLIKE '(?i)A' AND NOT p_type RLIKE 'zz'", "SELECT p_partkey FROM part WHERE regexp_matches(p_brand, '#[13]') AND regexp_matches(p_name, '(?i)A') AND NOT regexp_matches(p_type, 'zz')"),
    "expr_string": ("SELECT p_partkey, upper(p_name) AS u, lower(p_name) AS l, length(p_name) AS n, substring(p_name FROM 2 FOR 3) AS s, replace(p_name, 'a', 'b') AS r, left(p_name, 2) AS le, right(p_name, 2) AS ri, translate(p_name, 'ae', 'xy') AS t FROM part", "SELECT p_partkey, upper(p_name) AS u, lower(p_name) AS l, cast(length(p_name) AS INT) AS n, substring(p_name, 2, 3) AS s, replace(p_name, 'a', 'b') AS r, left(p_name, 2) AS le, right(p_name, 2) AS ri, translate(p_name, 'ae', 'xy') AS t FROM part"),
    "expr_trim": ("SELECT p_partkey, trim(BOTH 'B' FROM p_brand) AS b, trim(LEADING 'B' FROM p_brand) AS l, trim(TRAILING '1' FROM p_brand) AS t FROM part", "SELECT p_partkey, trim(p_brand, 'B') AS b, ltrim(p_brand, 'B') AS l, rtrim(p_brand, '1') AS t FROM part"),
    "expr_position": ("SELECT p_partkey, cast(position('a' IN p_name) AS BIGINT) AS p FROM part", None),
    "expr_concat": ("SELECT p_partkey, p_brand || '-' || p_type AS c, coalesce(NULLIF(p_brand, 'Brand#11'), 'none') AS n FROM part", None),
    "expr_datetime": ("SELECT event_id, cast(date_trunc('hour', ts) AS TIMESTAMP_NTZ) AS h, cast(extract(YEAR FROM ts) AS BIGINT) AS y, cast(extract(HOUR FROM ts) AS BIGINT) AS hh FROM events", "SELECT event_id, date_trunc('hour', ts) AS h, extract(YEAR FROM ts) AS y, extract(HOUR FROM ts) AS hh FROM events"),
    "expr_interval": ("SELECT event_id, ts + INTERVAL '1' DAY AS a, ts - INTERVAL '2' HOUR AS b FROM events WHERE ts < TIMESTAMP_NTZ '2100-01-01 00:00:00'", "SELECT event_id, ts + INTERVAL '1' DAY AS a, ts - INTERVAL '2' HOUR AS b FROM events WHERE ts < TIMESTAMP '2100-01-01 00:00:00'"),
    "expr_tz": ("SELECT event_id, convert_timezone('America/Denver', 'UTC', ts) AS u FROM events", "SELECT event_id, cast(timezone('America/Denver', ts) AT TIME ZONE 'UTC' AS TIMESTAMP) AS u FROM events"),
    "json_get": ("SELECT event_id, cast(get_json_object(props, '$.k') AS BIGINT) AS k FROM events", "SELECT event_id, cast(props->>'k' AS BIGINT) AS k FROM events"),
    "json_has_key": ("SELECT event_id, array_contains(json_object_keys(props), 'k') AS has FROM events", "SELECT event_id, list_contains(json_keys(props), 'k') AS has FROM events"),
    "array_literal": ("SELECT n_nationkey, array_join(array(n_name, 'x'), '|') AS a FROM nation", "SELECT n_nationkey, array_to_string([n_name, 'x'], '|') AS a FROM nation"),
    "array_index_slice": ("SELECT n_nationkey, element_at(split(n_name, ''), 1) AS f, array_join(slice(split(n_name, ''), 2, 2), '') AS s FROM nation", "SELECT n_nationkey, string_split(n_name, '')[1] AS f, array_to_string(string_split(n_name, '')[2:3], '') AS s FROM nation"),
    "array_overlap": ("SELECT n_nationkey, arrays_overlap(array(n_regionkey, n_nationkey), array(1, 2)) AS o FROM nation", "SELECT n_nationkey, list_has_any([n_regionkey, n_nationkey], [1, 2]) AS o FROM nation"),
    "array_any": ("SELECT n_nationkey FROM nation WHERE array_contains(array(1, 3), n_regionkey)", "SELECT n_nationkey FROM nation WHERE n_regionkey = ANY([1, 3])"),
    # statements that write, as rewrites
    "insert_values": ("SELECT r_regionkey, r_name FROM region UNION ALL VALUES (100, 'NEW')", None),
}


#: A nested document of each event, as both engines write it.
_DOCUMENTS = """SELECT event_id, '{"o":{"x":'||(event_id % 2)||',"l":[1,'||(event_id % 4)||']},"rows":[{"k":'||(event_id % 5)||'},{"n":null}]}' AS doc FROM events"""


def bound(spark: SparkSession, text: str, *values) -> DataFrame:
    """A query with parameters $1, $2, ... bound to values; those in strings and quoted names are text."""
    named = re.sub(r"""('(?:[^']|'')*'|"[^"]*")|\$(\d+)""", lambda m: m[1] or f":p{m[2]}", text)
    return spark.sql(named, args={f"p{k}": v for k, v in enumerate(values, 1)})


def create_table_as(spark: SparkSession, name: str, text: str, if_not_exists: bool = False) -> DataFrame:
    """CREATE TEMP TABLE name AS text: the rows are written, and later statements of the session find them by name."""
    if spark.catalog.tableExists(name):
        if if_not_exists:
            return spark.table(name)
        raise ValueError(f"{name} exists")
    path = shared_dir(spark, name)
    spark.sql(text).write.parquet(path)
    spark.read.parquet(path).createTempView(name)
    return spark.table(name)


def _created(s: SparkSession) -> DataFrame:
    name = f"status_{uuid.uuid4().hex}"
    try:
        create_table_as(s, name, "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
        create_table_as(s, name, "SELECT 1 AS x", if_not_exists=True)  # changes nothing
        return s.sql(f"SELECT o_orderstatus, n FROM {name}")
    finally:
        s.catalog.dropTempView(name)


def _documents(s):
    return s.sql(_DOCUMENTS)


def _upserts():
    from sqlsift.operators import upsert as u

    def old(s, d):
        return s.table("orders").select("o_orderkey", "o_orderstatus")

    def new(s, d):
        return s.table("orders").select((F.col("o_orderkey") + 5000).alias("o_orderkey"), F.lit("N").alias("o_orderstatus"))

    pair = "WITH o AS (SELECT o_orderkey, o_orderstatus FROM orders), n AS (SELECT o_orderkey + 5000 AS o_orderkey, 'N' AS o_orderstatus FROM orders) "
    return {
        "upsert_replace": (lambda s, d: u.replace(old(s, d), new(s, d), "o_orderkey"), pair + "SELECT * FROM n UNION ALL SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.o_orderkey = o.o_orderkey)"),
        "upsert_insert_only": (lambda s, d: u.insert_only(old(s, d), new(s, d), "o_orderkey"), pair + "SELECT * FROM o UNION ALL SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE n.o_orderkey = o.o_orderkey)"),
        "distinct_on": (lambda s, d: distinct_on(s.table("orders"), ["o_custkey"], [F.desc("o_totalprice"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey"), "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey DESC"),
        "expr_similar": (lambda s, d: s.table("part").filter(similar_to(F.col("p_brand"), "Brand#(1|2)_%")).select("p_partkey"), "SELECT p_partkey FROM part WHERE p_brand SIMILAR TO 'Brand#(1|2)..*'"),
        "json_contains": (lambda s, d: s.table("events").select("event_id", json_contains(F.col("props"), F.to_json(F.struct((F.col("event_id") % 100).alias("k")))).alias("has")), "SELECT event_id, json_contains(props, json_object('k', event_id % 100)) AS has FROM events"),
        "ctas": (lambda s, d: _created(s), "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus"),
        "bound_parameters": (
            lambda s, d: bound(s, "SELECT o_orderkey, '$1' AS text FROM orders WHERE o_totalprice > $2 AND o_orderstatus = $1 AND o_orderkey % $3 = 0", "F", 100000.0, 2),
            "SELECT o_orderkey, '$1' AS text FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'F' AND o_orderkey % 2 = 0",
        ),
        "json_contains_nested": (
            lambda s, d: _documents(s).select("event_id", json_contains(F.col("doc"), '{"o": {"x": 1, "l": [2]}}').alias("inner"), json_contains(F.col("doc"), '{"rows": [{"k": 1}, {"n": null}]}').alias("of_rows"), json_contained(F.to_json(F.struct(F.struct((F.col("event_id") % 3).alias("x")).alias("o"))), F.col("doc")).alias("part")),
            f"SELECT event_id, json_contains(doc, '{{\"o\": {{\"x\": 1, \"l\": [2]}}}}') AS inner, json_contains(doc, '{{\"rows\": [{{\"k\": 1}}, {{\"n\": null}}]}}') AS of_rows, json_contains(doc, '{{\"o\":{{\"x\":'||(event_id % 3)||'}}}}') AS part FROM ({_DOCUMENTS})",
        ),
        "json_delete_path": (
            lambda s, d: _documents(s).select("event_id", json_delete_path(F.col("doc"), "o", "l").alias("inner"), json_delete_path(F.col("doc"), "rows", "-1", "n").alias("of_rows"), json_delete_path(F.col("doc"), "zz").alias("none")),
            f"""SELECT event_id, '{{"o":{{"x":'||(event_id % 2)||'}},"rows":['||r||']}}' AS inner, '{{"o":{{"l":['||l||'],"x":'||(event_id % 2)||'}},"rows":['||r0||']}}' AS of_rows, '{{"o":{{"l":['||l||'],"x":'||(event_id % 2)||'}},"rows":['||r||']}}' AS none
              FROM (SELECT event_id, '1,'||(event_id % 4) AS l, '{{"k":'||(event_id % 5)||'}},{{"n":null}}' AS r, '{{"k":'||(event_id % 5)||'}},{{}}' AS r0 FROM events)""",
        ),
        "json_path": (lambda s, d: s.table("events").select("event_id", json_path(F.to_json(F.struct(F.array(F.col("props")).alias("a"), F.parse_json("props").alias("o"))), "o", "k").cast("long").alias("k")), "SELECT event_id, cast(props->>'k' AS BIGINT) AS k FROM events"),
        "json_keys_any_all": (lambda s, d: s.table("events").select("event_id", json_has(F.col("props"), ["k", "z"], False).alias("any_key"), json_has(F.col("props"), ["k", "z"], True).alias("all_keys"), json_without(F.col("props"), "k").alias("rest")), "SELECT event_id, list_has_any(json_keys(props), ['k', 'z']) AS any_key, list_has_all(json_keys(props), ['k', 'z']) AS all_keys, '{}' AS rest FROM events"),
        "delete_rewrite": (lambda s, d: u.delete_where(s.table("orders"), F.col("o_orderstatus") == "F").select("o_orderkey"), "SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F')"),
        "update_rewrite": (lambda s, d: u.update_where(s.table("orders"), F.col("o_orderstatus") == "F", o_orderpriority=F.lit("done")).select("o_orderkey", "o_orderpriority"), "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE o_orderpriority END AS o_orderpriority FROM orders"),
    }


def registry():
    """name -> (function of a session and folder, checking SQL)."""
    from sqlsift.session import with_views

    out = {}
    for name, (text, check) in SQL.items():
        out[name] = ((lambda s, d, text=text: with_views(s, d).sql(text)), check or text)
    for name, (f, check) in _upserts().items():
        out[name] = ((lambda s, d, f=f: f(with_views(s, d), d)), check)
    return out


def distinct_on(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key by `order`."""
    from pyspark.sql import Window

    return df.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_nth = 1").drop("_nth")


def similar_to(column, pattern: str):
    """SQL's SIMILAR TO as an anchored regular expression. Within brackets only a leading ^, ranges and [:classes:] are special."""
    out, at = "", 0
    while at < len(pattern):
        c = pattern[at]
        if c == "\\" and at + 1 < len(pattern):
            out, at = out + "\\" + pattern[at + 1], at + 1
        elif c == "[":
            end = at + 1 + (pattern[at + 1 : at + 2] == "^")
            end += pattern[end : end + 1] == "]"
            while end < len(pattern) and pattern[end] != "]":
                end += 2 if pattern[end] == "\\" else pattern.index(":]", end) + 2 - end if pattern.startswith("[:", end) and ":]" in pattern[end:] else 1
            inner = pattern[at + 1 : end]
            negated = inner.startswith("^")
            inner = re.sub(r"\[:(\w+):\]|([\[\]&^])", lambda m: rf"\p{{{m[1].title()}}}" if m[1] else "\\" + m[2], inner[negated:])
            out, at = out + "[" + "^" * negated + inner + "]", end
        else:
            out += {"%": ".*", "_": "."}.get(c, "\\" + c if c in ".^$" else c)
        at += 1
    return column.rlike(f"(?s)^(?:{out})$")
