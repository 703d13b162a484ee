"""What is found by shapes is what is found for each text."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from test_sqltext import CANONICAL, EXPRESSIONS, MASKED

from sqlsift.functions.analyze import analyze_text
from sqlsift.sqltext.shapes import Templates, shape

ODD = [
    "select 'open", "select 08 from t where a = 5", "select (1 from t", "alter table t5 add c int 7", "create view v as select 1", "update 5 set a = 1 from t", "update 'a.b' set c = 1", "update 5.5 set c = 1",
    "with 5 as (select 1) update 5 set a = 2", "select a . 1, b . /* 2 */ 3, c.4, d -- . 5\n . 'x' from t", "select .5.5, 1..2, 1.e5, 1 .5 from t", "select 1abc, 1'x', e'1\\'2' '3', E'4''5' from t",
    "select cast(a as numeric(10,2)), b::varchar(5), c::int[3] from t", "select timestamp '2020-01-01 00:00:00', timestamp with time zone '5', interval '1 day', interval 3 day from t", "select a #--1 'b'\n from t where x = 2",
    "select sum(a) over (order by b rows between 3 preceding and 'abC' following) from t", "begin 'abC' 5; set session characteristics 'abC' 7; show transaction 'x'", "analyze (buffer_usage_limit 'abC' 12 34) t", "analyze (verbose 1) t",
    "select 1 as one, 'x' as x, 2 \"3\" from \"4\" where \"a''5\" = '6''7' -- 8 '9'\n and /* 10 '11' */ b = $12 and c in (13, '14', 15.) limit 16 offset 17", "create index on t (a) where b = 18 and c = '19'", "create temp table t20 as select 21 as a, '22' from u23 where x = 24.5",
    "select 7391846205 from t where a = 1", "insert into t (a) values (1, 'a,b'), (2, 'c')", "savepoint 5; set timezone to 'uTc'; set x = 'off'; rollback to 7", "fetch 'x'", "", "select a from t fetch first 5 rows only for update of 6", "select '" + "ab, 'c".replace("'", "''") + "'::varchar('a ,b') from t", "select a from t, t5 6",
]


def changed(sql, draw):
    """Other literals where the text has whole numbers or plain strings."""
    sql = re.sub(r"(?<![\w.$])[1-9]\d*(?![\w.])", lambda m: str(draw.randrange(1, 10**12)), sql)
    return re.sub(r"(?<![\w'\\])'[a-zA-Z]*'(?!')", lambda m: "'" + draw.choice(["", "aB", "a.b", "Ü ,x", "it''s 5", "--", "x;\ny"]) + "'", sql)


@pytest.mark.parametrize("sql", [s for s, _ in CANONICAL + MASKED] + ODD)
def test_as_one_by_one(sql):
    by_shape, draw = Templates(analyze_text), random.Random(sql)
    for text in [sql, *[changed(sql, draw) for _ in range(6)]]:
        assert by_shape(text) == analyze_text(text), text


@settings(max_examples=200, deadline=None)
@given(EXPRESSIONS, st.integers(1, 10**9), st.text("ab.'-/*\"e5$ ,", max_size=12))
def test_expressions_as_one_by_one(e, number, junk):
    by_shape = Templates(analyze_text)
    for text in (f"select {e} from t where {e} and x = 1", f"select {e} from t where {e} and x = {number}", f"select {e}, '{junk.replace(chr(39), chr(39) * 2)}' from t where {e} and x = {number}", f"select 5 {junk} from t where x = {number}"):
        assert by_shape(text) == analyze_text(text), text


def test_texts_that_differ_in_literals_are_parsed_once():
    parsed = []
    by_shape = Templates(lambda sql: parsed.append(sql) or analyze_text(sql))
    for k in range(1, 200):
        (s,) = by_shape(f"select e.a, 'n{k}' from e join u on e.a = u.id where e.value > {k} and e.x < {k}.5")["statements"]
        assert s["unmasked"] == f"(SELECT e.a, 'n{k}' FROM e INNER JOIN u ON (e.a = u.id) WHERE ((e.value > {k}) AND (e.x < {k}.5)));"
    assert len(parsed) == 1 and shape("select 1 from t")[1] == ["1"]


def test_the_udf(spark):
    from sqlsift.functions.analyze import analyze

    texts = [None, "", "select 'a", *[f"select a from t where b = {k}" for k in range(50)]]
    got = {r.query: r.a.asDict(True) for r in spark.createDataFrame([(t,) for t in texts], "query string").withColumn("a", analyze("query")).collect()}
    assert got == {t: analyze_text(t) for t in texts}


def test_the_udf_is_called_once(spark):
    from pyspark.sql import functions as F

    from sqlsift.plans import ingest

    rows = spark.range(10).select(F.concat(F.lit("select a from t where b = "), F.col("id") % 2).alias("query"))
    found = ingest.analyzed(rows).select("query", F.explode("statements").alias("s")).select("query", F.explode("s.columns").alias("c"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and found.count() == 4


def test_one_statement_a_query_without_sorting_texts(spark):
    from sqlsift.plans import ingest

    rows = spark.createDataFrame([(f"select f(a) from t{k % 3} where b = {k}; select g(a) from u where b = {k}",) for k in range(60)], "query string")
    texts = ingest.analyzed(rows).localCheckpoint()
    once = ingest._once(texts)
    assert sorted(r.masked for r in once.select("masked").collect()) == [f"(SELECT f(a) FROM t{k} WHERE (b = ?));" for k in range(3)] + ["(SELECT g(a) FROM u WHERE (b = ?));"]
    plan = once.select("query_uid")._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan
