"""Two loads into a stored star schema: files are taken once, old rows stay or new ones win, bad input is kept."""

import json

from sqlsift.plans import load
from sqlsift.sources.tables import read_staged, write_staged

P = "2024-07-08 {} UTC:10.0.0.1(1):{}@{}:[7]:LOG:  duration: {} ms  statement: {}\n"


def test_two_loads(spark, tmp_path):
    root = str(tmp_path / "star")
    one = P.format("15:00:01", "ann", "shop", 2, "select u.id from users u where u.id = 1") + P.format("15:00:02", "bob", "shop", 4, "select u.id from users u where u.id = 2") + P.format("16:00:00", "bob", "shop", 1, "alter nothing at all (") + "no prefix\n"
    two = "lost line\n" + P.format("15:30:00", "ann", "other", 9, "select u.id from users u where u.id = 3") + P.format("17:00:00", "ann", "other", 9, "update t set a = 1 where b = 2")
    schema = "file string, text string"
    assert load.version(spark, root) == 0 and load.tables(spark, root) == {}
    got = load.load(spark, spark.createDataFrame([("a.log", one)], schema), root, "app", "http://app/")
    assert got == {"files": 1, "entries": 3, "executions": 3, "texts": 3, "parsed": 3, "errors": 1, "quarantined": 0}
    got = load.load(spark, spark.createDataFrame([("a.log", one), ("b.log", two)], schema), root)
    assert (got["files"], got["executions"], got["quarantined"]) == (1, 2, 1) and load.version(spark, root) == 2
    again = load.load(spark, spark.createDataFrame([("b.log", two)], schema), root)
    assert (again["files"], again["parsed"]) == (0, 0)
    t = load.tables(spark, root)
    assert {r.file_name for r in t["processed_files"].collect()} == {"a.log", "b.log"} and t["queries"].count() == 2 and t["error_texts"].first().query.startswith("alter")
    assert {r.name for r in t["sources"].collect()} == {"app", ""} and {r.table_name for r in t["tables"].collect()} == {"users", "t"}
    hours = {(r.queried_hour, r.total_count, r.total_duration_us) for r in t["queries_by_hours"].collect()}
    assert hours == {(15, 3, 15000), (17, 1, 9000)}  # the same query and hour: loads add up
    assert t["query_users"].count() == 3 and t["quarantined"].first().entry == "lost line\n" and load.tables(spark, root, 1)["queries"].count() == 1


SCHEMA = "file string, text string"
LINE = "2024-07-{:02} {:02}:00:00 UTC:10.0.0.1(1):{}@shop:[7]:LOG:  duration: {} ms  statement: select a from t{} where x = 1\n"


def rows_of(t, name, *columns):
    return sorted(tuple(r) for r in t[name].select(*columns).collect())


def state(spark, root):
    t = load.tables(spark, root)
    return {k: rows_of(t, k, *[c for c in t[k].columns if c != "processed_at"]) for k in t if k not in ("texts",)}


def frame(spark, **files):
    return spark.createDataFrame([(k, v) for k, v in files.items()], SCHEMA)


def test_replace_takes_the_later_load(spark, tmp_path):
    root = str(tmp_path)
    for name, took in (("a", 2), ("b", 9)):
        load.load(spark, frame(spark, **{name: LINE.format(8, 15, "ann", took, 1)}), root, hours="replace")
    assert rows_of(load.tables(spark, root), "queries_by_hours", "total_count", "total_duration_us") == [(1, 9000)]


def test_a_file_read_again_replaces_its_share(spark, tmp_path):
    one, two = LINE.format(8, 15, "ann", 2, 1) + LINE.format(8, 16, "bob", 3, 1), LINE.format(8, 15, "ann", 5, 1)
    mended = LINE.format(8, 15, "ann", 4, 1) + LINE.format(9, 1, "cid", 7, 1)
    load.load(spark, frame(spark, a=one, b=two), str(tmp_path / "x"))
    load.load(spark, frame(spark, a=mended), str(tmp_path / "x"), reread=True)
    load.load(spark, frame(spark, a=mended, b=two), str(tmp_path / "y"))
    got, want = state(spark, str(tmp_path / "x")), state(spark, str(tmp_path / "y"))
    for name in ("queries_by_hours", "query_users", "hour_shares", "user_shares"):
        assert got[name] == want[name]
    assert [r[0] for r in rows_of(load.tables(spark, str(tmp_path / "x")), "queries_by_hours", "total_duration_us")] == [7000, 9000]


def test_loads_at_once_both_stay(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    root, files = str(tmp_path), [{f"f{k}": LINE.format(8, 15, "ann", k + 1, k % 2)} for k in range(3)]
    with ThreadPoolExecutor(3) as pool:
        got = list(pool.map(lambda f: load.load(spark, frame(spark, **f), root), files + files[:1]))
    assert load.version(spark, root) == 4 and sum(g["files"] for g in got) == 3
    assert rows_of(load.tables(spark, root), "queries_by_hours", "total_count", "total_duration_us") == [(1, 2000), (2, 4000)]
    assert load.tables(spark, root)["processed_files"].count() == 3


def test_few_new_keys_rewrite_few_buckets(spark, tmp_path, monkeypatch):
    from sqlsift.plans import store

    monkeypatch.setattr(store, "FULL", 40)
    s = store.Store(spark, str(tmp_path))

    def keyed(ids, value):
        return spark.createDataFrame([(f"{i * 0x9E3779B1 % (1 << 32):08x}", i, value) for i in ids], "uid string, i long, v string")

    t = s.merge(None, keyed(range(2000), "old"), True, "data/t/1")
    assert t.digits == 2 and len(t.folders) > 200 and sum(t.rows.values()) == 2000
    before = {f for fs in t.folders.values() for f in fs}
    t2 = s.merge(t, keyed([5, 7, 2001, 2002], "new"), True, "data/t/2")
    after = {f for fs in t2.folders.values() for f in fs}
    assert len(before - after) == 2 and len(after - before) <= 6  # two buckets rewritten, four rows added
    want = {i: "new" if i in (5, 7, 2001, 2002) else "old" for i in [*range(2000), 2001, 2002]}
    assert {r.i: r.v for r in s.read(t2).collect()} == want and sum(t2.rows.values()) == 2002
    t3 = s.merge(t2, keyed([5, 2003], "newer"), False, "data/t/3")  # old rows stay
    assert len({f for fs in t3.folders.values() for f in fs} - after) == 1 and {r.i: r.v for r in s.read(t3).collect()} == want | {2003: "newer"}
    t4 = s.merge(t3, keyed([9], "old"), True, "data/t/4")  # the same row once more
    assert t4.folders == t3.folders
    t5 = s.merge(t4, keyed([], "x"), True, "data/t/5", gone=keyed([11], "x"))
    assert {r.i for r in s.read(t5).collect()} == set(want) - {11} | {2003} and sum(t5.rows.values()) == 2002
    monkeypatch.setattr(store, "FULL", 1)
    t6 = s.merge(t5, keyed([3000], "x"), True, "data/t/6")
    assert t6.digits == 3 and s.read(t6).count() == 2003
    for k in range(store.MANY + 1):
        t6 = s.merge(t6, keyed([5], f"{k}"), True, f"data/t/many{k}")
    assert max(map(len, t6.folders.values())) <= store.MANY and s.read(t6).filter("i = 5").first().v == f"{store.MANY}"


def test_changes_in_many_dates_are_one_read(spark, tmp_path, monkeypatch):
    from sqlsift.plans import store

    monkeypatch.setattr(store, "FULL", 100)
    monkeypatch.setattr(store, "MANY", 2)
    s = store.Store(spark, str(tmp_path))

    def dated(value):
        return spark.range(1000).selectExpr("sha1(string(id)) AS uid", "id AS i", "date_add(date'2024-01-01', int(id % 20)) AS d", f"CASE WHEN id < 40 THEN '{value}' ELSE 'old' END AS v").repartition(2)

    t = s.merge(None, dated("old"), True, "data/t/1", "d")
    assert t.digits == 0 and len(t.folders) == 20  # 50 rows of each date: no more buckets for them
    reads, read = [], store.Store.read
    monkeypatch.setattr(store.Store, "read", lambda self, table, buckets=None: reads.append(table) or read(self, table, buckets))
    for k in range(1, 4):
        reads.clear()
        t = s.merge(t, dated(f"new{k}").filter("i < 40 or i >= 900"), True, f"data/t/{k + 1}", "d", gone=dated("old").filter("i = 500 or i < 10"))
        assert len(reads) <= 3
        assert {r.i: r.v for r in read(s, t).collect()} == {i: f"new{k}" if i < 40 else "old" for i in range(1000) if i != 500}
        assert sum(t.rows.values()) == 999


def test_folder_of_a_file(spark):
    from sqlsift.plans.store import folder_of

    path = "file:///a/b%20c/root/data/t/0123-0/bucket=2024-01-01.a/part-00000-5.c000.snappy.parquet"
    rows = spark.range(1).selectExpr(f"'{path}' AS p").select(folder_of("p").alias("f"))
    assert rows.first().f == "data/t/0123-0/bucket=2024-01-01.a"
    assert "regexp" not in rows._jdf.queryExecution().toString().lower()


def test_expire(spark, tmp_path):
    root = str(tmp_path)
    for k in range(3):
        load.load(spark, frame(spark, **{f"f{k}": LINE.format(8, 15, "ann", k + 1, 1)}), root)
    kept = state(spark, root)
    assert load.expire(spark, root, keep=1, older=0) > 0 and load.expire(spark, root, keep=1, older=0) == 0
    assert state(spark, root) == kept and not list((tmp_path / "staging").glob("*/*"))


def test_owners_are_stored(spark, tmp_path):
    root, kind = str(tmp_path), "database string, data array<struct<`table`: string, owners: array<string>>>"
    load.load(spark, frame(spark, f=LINE.format(8, 15, "ann", 1, 1)), root)
    for owners in ([("t1", ["x", "y"]), ("s.b", ["x"])], [("t1", ["y", "z"])]):
        load.load_owners(spark, spark.createDataFrame([("shop", owners)], kind), root)
    t = load.tables(spark, root)
    assert rows_of(t, "owners", "name") == [("x",), ("y",), ("z",)] and t["owners_tables"].count() == 4
    assert rows_of(t, "tables", "table_name", "table_type") == [("b", "owners_import"), ("t1", None)]
    assert t["owners_tables"].join(t["tables"], t.get("tables")["uid"] == t["owners_tables"]["table_uid"]).count() == 4


def test_staged(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({"databases": {"u1": {"uid": "u1", "name": "shop"}, "u2": {"uid": "u2", "name": None}}}))
    got = read_staged(spark, str(tmp_path / "d.json"), "databases", "uid string, name string")
    assert sorted(map(tuple, got.collect())) == [("u1", "u1", "shop"), ("u2", "u2", None)]
    write_staged(got, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2
