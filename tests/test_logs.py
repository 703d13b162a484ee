"""Log text to executions: pairing, filters, zones, units."""

from sqlsift.functions.ids import uuid5
from sqlsift.operators.relational import similar_to
from sqlsift.operators.upsert import add, insert_only, replace, unprocessed
from sqlsift.sources import logs
from pyspark.sql import functions as F

P = "2024-07-08 15:00:0{} MDT:10.0.0.1({}):ann@shop:[7]:{}:  "


def parsed(spark, text):
    return logs.entries(spark.createDataFrame([("f", text)], "file string, text string"))


def test_entries_and_pairing(spark):
    text = (
        P.format(1, 1, "LOG") + "statement: select 1\n   from t;\n" + P.format(2, 2, "LOG") + "duration: 1.410 ms\n" + P.format(3, 1, "LOG") + "duration: 0.059 ms  execute <unnamed>: select '2024-01-01 x'\n"
        + P.format(4, 1, "LOG") + "duration: 0.1 ms  bind R42: select 2\n" + P.format(5, 1, "ERROR") + "syntax error at x\n" + P.format(6, 1, "LOG") + "parameters: $1 = 'a'\n" + P.format(7, 1, "LOG") + "duration: 9 ms\n"
    ).replace("10.0.0.1(2)", "10.0.0.1(2)")
    rows = parsed(spark, text).orderBy("entry_no").collect()
    assert [r.prepared_step for r in rows] == ["statement", "", "execute", "bind", "", "", ""]
    assert rows[0].query == "select 1\nfrom t;" and rows[3].prepared_name == "R42"
    assert rows[4].error == "syntax error at x" and rows[5].parameters == "$1 = 'a'"
    runs = logs.executions(logs.paired(parsed(spark, text))).orderBy("entry_no").collect()
    assert [(r.query, r.duration_us, r.local_time.second, r.hour.hour, r.utc_time.hour) for r in runs] == [("select 1\nfrom t;", 1410, 1, 15, 21), ("select '2024-01-01 x'", 59, 3, 15, 21)]


def test_ipv6_and_quarantine(spark):
    text = "no prefix here\n2024-07-08 15:00:01 UTC:::1(63248):bob@db:[9]:LOG:  duration: 2 sec  statement: select 1\n"
    files = spark.createDataFrame([("f", text)], "file string, text string")
    assert [(r.remote_host, r.user, r.database, r.pid) for r in logs.entries(files).collect()] == [("::1", "bob", "db", 9)]
    assert logs.quarantined(files).count() == 1
    assert logs.executions(logs.entries(files)).first().duration_us == 2_000_000


def test_unknown_zones_and_times_are_quarantined(spark):
    at = "{} {}:10.0.0.1(1):ann@shop:[7]:LOG:  duration: 1 ms  {}: select {}\n".format
    text = (
        "no prefix\n" + at("2024-07-08 15:00:01", "CET", "statement", 1) + at("2024-07-08 15:00:02", "UTC", "statement", 2) + at("2024-13-45 15:00:03", "UTC", "execute <unnamed>", 3)
        + at("2024-02-30 15:00:03", "UTC", "statement", 4) + at("2024-07-08 15:00:04", "JST", "bind x", 5) + at("2024-07-08 15:00:05", "MDT", "execute x", 6)
    )
    files = spark.createDataFrame([("f", text)], "file string, text string")
    entries, kept = logs.entries(files), logs.quarantined(files).orderBy("entry_no").collect()
    runs, others = logs.executions(entries).collect(), entries.filter("prepared_step not in ('statement', 'execute')").count()
    assert [r.query for r in runs] == ["select 2", "select 6"] and others == 1
    assert [r.entry.strip()[-8:] for r in kept] == ["o prefix"[-8:], "select 1", "select 3", "select 4"]
    assert len(text.splitlines()) == len(runs) + others + len(kept)


def test_later_hold_replaces_and_empty_input(spark):
    text = P.format(1, 1, "LOG") + "statement: a\n" + P.format(2, 1, "LOG") + "statement: b\n" + P.format(3, 1, "LOG") + "duration: 3 ms\n" + P.format(4, 1, "LOG") + "duration: 4 ms\n"
    assert [(r.query, r.duration_us) for r in logs.executions(logs.paired(parsed(spark, text))).collect()] == [("b", 3000)]
    assert logs.executions(logs.paired(parsed(spark, ""))).count() == 0


def test_uuid5_and_similar(spark):
    import uuid

    got = spark.range(1).select(uuid5(F.lit("select 1;")).alias("u"), similar_to(F.lit("abc.d"), "(ab|x)%.d").alias("s"), similar_to(F.lit("abcxd"), "(ab|x)%.d").alias("n")).first()
    assert got.u == str(uuid.uuid5(uuid.UUID("018e1b50-ee98-73f2-9839-420223323163"), "select 1;")) and got.s and not got.n


def test_upserts(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "uid string, n long")
    new = spark.createDataFrame([("b", 5), ("c", 6)], "uid string, n long")
    assert sorted(map(tuple, insert_only(old, new).collect())) == [("a", 1), ("b", 2), ("c", 6)]
    assert sorted(map(tuple, replace(old, new).collect())) == [("a", 1), ("b", 5), ("c", 6)]
    assert sorted(map(tuple, add(old, new, "uid", ["n"]).collect())) == [("a", 1), ("b", 7), ("c", 6)]
    files = spark.createDataFrame([("x",), ("y",)], "file string")
    assert [r.file for r in unprocessed(files, spark.createDataFrame([("x",)], "file_name string")).collect()] == ["y"]


def test_registered_queries_read_their_log_once(spark):
    from __spark_entry__ import queries

    for name in ("log_pairing", "log_sessions", "log_roundtrip"):
        found = queries()[name](spark, "/root/testdata/sf0.001")
        assert "server_logs" not in found._jdf.queryExecution().executedPlan().toString() and found.count() == 1000, name


def test_followed_by_brute_force(spark):
    import random

    from sqlsift.sources.logs import followed

    deal = random.Random(7)
    rows = [(age, f"f{file}", no, f"u{deal.randrange(4)}", "hold" if not age else deal.choice(["hold", "duration", "whole"]), str(deal.randrange(99))) for age in (0, 1) for file in range(3) for no in deal.sample(range(300), 40)]
    want, last = [], {}
    for age, file, no, who, kind, lit in sorted(rows, reverse=True):
        if kind == "hold":
            want.append((age, file, no, last.get(who)))
        if kind != "whole":
            last[who] = (kind, no, lit)
    df = spark.createDataFrame(rows, "age int, file string, entry_no long, user string, kind string, duration_lit string").withColumn("duration_measure", F.lit("ms"))
    for span in (1, 7, 64, 1 << 26):
        got = [(r.age, r.file, r.entry_no, r.next and (r.next.kind, r.next.entry_no, r.next.duration_lit)) for r in followed(df, ["user"], span, "age").collect()]
        assert sorted(got, key=str) == sorted(want, key=str), span
