"""Log text to the star schema, end to end; the UDF on bad texts; the owners import."""

from sqlsift.functions.analyze import analyze_text
from sqlsift.plans import ingest
from sqlsift.sources import logs

P = "2024-07-08 {} MDT:10.0.0.1(1):ann@shop:[7]:LOG:  "


def test_star(spark):
    text = (
        P.format("15:00:01") + "duration: 2 ms  statement: select u.id from users u where u.id = 1\n" + P.format("15:10:01") + "duration: 4 ms  statement: select x.id from users x where x.id = 2\n"
        + P.format("16:00:01") + "duration: 10 ms  statement: begin; update t set a = 1 where b = 2; commit\n" + P.format("16:00:02") + "duration: 1 ms  statement: alter nothing at all (\n"
    )
    runs = logs.executions(logs.entries(spark.createDataFrame([("f", text)], "file string, text string"))).cache()
    star = ingest.star(runs, ingest.analyzed(runs).cache())
    masked = {r.masked_query: (r.command, r.unmasked_query) for r in star["queries"].collect()}
    assert masked["(SELECT users.id FROM users WHERE (users.id = ?));"] == ("SELECT", "(SELECT users.id FROM users WHERE (users.id = 1));") and len(masked) == 4
    hours = sorted((r.queried_hour, r.total_count, r.total_duration_us, r.total_queries_in_transaction) for r in star["queries_by_hours"].collect())
    assert hours == [(15, 2, 6000, 2), (16, 1, 0, 1), (16, 1, 5000, 2), (16, 1, 5000, 2)]
    assert {r.table_name for r in star["tables"].collect()} == {"users", "t"}
    assert {(r.clause, r.table_name, r.column_name) for r in star["columns_in_queries"].collect()} == {("SELECT", "users", "id"), ("WHERE", "users", "id"), ("WHERE", "t", "b")}
    assert star["errors"].first()["count"] == 1 and star["query_users"].count() == 4


def test_bad_texts():
    assert analyze_text(None) == analyze_text("") == {"error": None, "statements": []}
    assert analyze_text("select (" + "(" * 100000)["error"] == "nested too deep"
    assert analyze_text("x" * (1 << 21))["error"] == "text too long" and analyze_text("select 'a")["error"]


def test_long_and_deep_texts():
    long = "insert into t (a, b) values " + ", ".join(f"({i}, 'text {i}')" for i in range(60_000))
    assert len(long) > 1 << 20
    got = analyze_text(long)
    assert got["error"] is None and got["statements"][0]["masked"] == "(INSERT INTO t (a, b) VALUES (?, '?'));"
    for op, n in (("or", 3000), ("and", 3000), ("||", 3000)):
        got = analyze_text("select t.id from t join u on " + f" {op} ".join(f"t.a{i} = u.b{i}" if op != "||" else f"t.a{i}" for i in range(n)))
        s = got["statements"][0]
        assert got["error"] is None and len(s["joins"]) == 1 and s["tables"] == [{"schema_name": "public", "table_name": "t"}, {"schema_name": "public", "table_name": "u"}]
        assert s["masked"].count(f" {op.upper()} ") == n - 1
    n = 1500
    got = analyze_text("select id from t where " + "(" * n + "a = 0" + "".join(f" or a = {i})" for i in range(n)))
    assert got["error"] is None and got["statements"][0]["masked"] == "(SELECT id FROM t WHERE " + "(" * n + "(a = ?)" + " OR (a = ?))" * n + ");"
    got = analyze_text(" union all ".join(f"select a from t{i}" for i in range(1200)))["statements"][0]
    assert len(got["tables"]) == 1200 and got["tables"][-1]["table_name"] == "t1199"
    assert analyze_text("select '" + "it''s " * 500_000 + "', e'a\\'b''c' from t")["statements"][0]["masked"] == "(SELECT '?', ? FROM t);"


def test_owners(spark):
    rows = spark.createDataFrame([("shop", [("a", ["x", "y"]), ("s.b", ["x"]), ("p.q.r", ["z"])])], "database string, data array<struct<`table`: string, owners: array<string>>>")
    out = ingest.owners(rows, spark.createDataFrame([], "uid string"))
    assert sorted((r.schema_name, r.table_name) for r in out["tables"].collect()) == [("public", ""), ("public", "a"), ("s", "b")]
    assert out["owners"].count() == 3 and out["owners_tables"].count() == 4
