"""Log files that arrive one after the other, and an hour that is late."""

from pyspark.errors import StreamingQueryException

from sqlsift.streaming import hourly

P = "2024-07-08 {} UTC:10.0.0.1(1):ann@shop:[7]:LOG:  duration: {} ms  statement: select {}\n"


def test_hourly(spark, tmp_path):
    logs, state = tmp_path / "logs", tmp_path / "state"
    logs.mkdir()

    def step(name, text):
        (logs / name).write_text(text)
        q = hourly.hourly(hourly.watch(spark, str(logs))).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(state)).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)
        return sorted((r.hour.hour, r.total_count, r.total_duration_us) for r in spark.read.schema("database string, query_text_uid string, hour timestamp_ntz, total_count long, total_duration_us long").parquet(str(tmp_path / "out")).collect())

    assert step("a.log", P.format("10:00:00", 1, 1) + P.format("10:30:00", 2, 1)) == []
    assert step("b.log", P.format("10:45:00", 3, 1) + P.format("15:00:00", 4, 1)) == [(10, 3, 6000)]
    assert step("c.log", P.format("10:50:00", 5, 1) + P.format("19:00:00", 6, 1)) == [(10, 3, 6000), (15, 1, 4000)]  # too late: left out


HEAD = "2024-07-08 {} UTC:{}:{}@shop:[7]:LOG:  "


def hold(at, user, n, host="10.0.0.1(1)"):
    return HEAD.format(at, host, user) + f"statement: select a from t{n}\n  where b = 1\n"


def took(at, user, ms, host="10.0.0.1(1)"):
    return HEAD.format(at, host, user) + f"duration: {ms} ms\n"


def test_pairs_over_batches_and_restarts(spark, tmp_path, monkeypatch):
    from sqlsift.plans import load
    from sqlsift.plans.store import Store
    from sqlsift.sources import logs
    from sqlsift.streaming import sessions

    folder, root, other = tmp_path / "logs", str(tmp_path / "star"), str(tmp_path / "batch")
    folder.mkdir()

    def step(name, text):
        with (folder / name).open("a") as f:
            f.write(text)
        q = sessions.into_store(sessions.watch(spark, str(folder), settle_seconds=0), root, str(tmp_path / "state"), "s")
        try:
            q.awaitTermination(300)
        except StreamingQueryException as e:
            return e

    assert step("a.log", hold("10:00:00", "ann", 1) + hold("10:00:01", "bob", 2) + "2024-07-08 10:00:02 UTC:nonsense\n") is None
    at = load.version(spark, root)
    commit = Store.commit
    monkeypatch.setattr(Store, "commit", lambda self, *a: (_ for _ in ()).throw(OSError("killed before the commit")))
    more = took("10:00:03", "ann", 5) + hold("10:00:04", "ann", 1) + took("11:00:00", "bob", 7, "[local]") + hold("11:00:00", "bob", 3, "[local]")
    assert step("a.log", more) is not None and load.version(spark, root) == at
    monkeypatch.setattr(Store, "commit", lambda self, *a: commit(self, *a) and (_ for _ in ()).throw(OSError("killed behind the commit")))
    assert step("a.log", "") is not None and load.version(spark, root) == at + 1
    monkeypatch.setattr(Store, "commit", commit)
    assert step("a.log", took("10:00:05", "ann", 6) + took("11:00:01", "bob", 8, "[local]")) is None
    assert step("a.log", "") is None  # a start that finishes a failed batch may leave what is newer to the next
    load.load(spark, logs.read_logs(spark, str(folder)), other)
    for name in ("queries_by_hours", "query_users", "queries", "texts", "tables_in_queries"):
        columns = [c for c in load.tables(spark, other)[name].columns if c != "source_uid"]
        got, want = (sorted(map(str, load.tables(spark, r)[name].select(*columns).collect())) for r in (root, other))
        assert got == want and want
    assert [r.total_duration_us for r in load.tables(spark, root)["queries_by_hours"].orderBy("total_duration_us").collect()] == [8000, 11000]
    assert load.tables(spark, root)["quarantined"].count() == 1


def test_pairs_over_files_and_timers(spark, tmp_path):
    from sqlsift.sources import logs
    from sqlsift.streaming import sessions

    folder = tmp_path / "logs"
    folder.mkdir()

    def step(name, text, wait):
        (folder / name).write_text(text)
        rows = sessions.paired(logs.parsed(sessions.watch(spark, str(folder), settle_seconds=0)), by_file=False, wait_hours=wait)
        q = rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination(300)
        return sorted((r.file[-5:], r.query[:16], r.duration_lit) for r in spark.read.schema(rows.schema).parquet(str(tmp_path / "out")).collect())

    assert step("a.log", hold("10:00:00", "ann", 1), 24) == []
    assert step("b.log", took("10:00:01", "ann", 5) + hold("10:00:02", "ann", 2), 0) == [("a.log", "select a from t1", "5")]
    step("c.log", took("12:00:00", "cid", 1), 0)  # time passes: the timer lets go
    assert step("d.log", took("10:00:09", "ann", 9), 0) == [("a.log", "select a from t1", "5")]


def test_clients_of_one_group_keep_apart(spark, tmp_path, monkeypatch):
    from sqlsift.sources import logs
    from sqlsift.streaming import sessions

    monkeypatch.setattr(sessions, "GROUPS", 2)
    folder = tmp_path / "logs"
    folder.mkdir()

    def step(name, text):
        (folder / name).write_text(text)
        rows = sessions.paired(logs.parsed(sessions.watch(spark, str(folder), settle_seconds=0)), by_file=False)
        q = rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination(300)
        return sorted((r.user, r.query.split("\n")[0], r.duration_lit) for r in spark.read.schema(rows.schema).parquet(str(tmp_path / "out")).collect())

    people = [f"p{k:02}" for k in range(30)]
    assert step("a.log", "".join(hold("10:00:00", p, k) for k, p in enumerate(people))) == []
    got = step("b.log", "".join(took("10:00:01", p, k) for k, p in enumerate(people) if k % 3))
    assert got == [(p, f"select a from t{k}", str(k)) for k, p in enumerate(people) if k % 3]
    got = step("c.log", "".join(took("10:00:02", p, 100 + k) for k, p in enumerate(people)))
    assert [x for x in got if int(x[2]) >= 100] == [(p, f"select a from t{k}", str(100 + k)) for k, p in enumerate(people) if not k % 3]


def test_waiting_statements_are_rows_of_the_store(spark, tmp_path):
    from sqlsift.plans import load
    from sqlsift.plans.store import Store
    from sqlsift.streaming import sessions

    folder, root = tmp_path / "logs", str(tmp_path / "star")
    folder.mkdir()

    def step(name, text, wait=24):
        (folder / name).write_text(text)
        q = sessions.into_store(sessions.watch(spark, str(folder), settle_seconds=0), root, str(tmp_path / "state"), "s", by_file=False, wait_hours=wait)
        q.awaitTermination(300)
        assert all(not p["stateOperators"] for p in q.recentProgress) and len(q.recentProgress) == 1
        store = Store(spark, root)
        waiting = store.read(store.version().open["s"])
        return sorted((r.user, r.query.split("\n")[0]) for r in waiting.collect()), [r.total_duration_us for r in load.tables(spark, root)["queries_by_hours"].orderBy("total_duration_us").collect()]

    assert step("m.log", hold("10:00:00", "ann", 1) + hold("10:00:01", "ann", 2) + hold("10:00:02", "bob", 3)) == ([("ann", "select a from t2"), ("bob", "select a from t3")], [])
    load.expire(spark, root, keep=1, older=0.0)
    # a file of an earlier name comes later; a second duration finds nothing
    assert step("a.log", took("10:00:03", "ann", 5) + took("10:00:04", "ann", 6) + hold("10:00:05", "cid", 4), 0) == ([("bob", "select a from t3"), ("cid", "select a from t4")], [5000])
    load.expire(spark, root, keep=1, older=0.0)
    assert step("b.log", took("10:00:06", "cid", 7), 0) == ([("bob", "select a from t3")], [5000, 7000])
    assert load.load_batch(spark, spark.createDataFrame([], "entry string"), root, "s", 2) == {}  # it was committed
    assert step("c.log", hold("10:00:07", "bob", 5)) == ([("bob", "select a from t5")], [5000, 7000])
    assert step("d.log", took("10:00:08", "bob", 9)) == ([], [5000, 7000, 9000])


def test_waiting_statements_are_let_go(spark, tmp_path):
    from sqlsift.plans.store import Store
    from sqlsift.streaming import sessions

    folder, root = tmp_path / "logs", str(tmp_path / "star")
    folder.mkdir()
    for name, text, left in (("a.log", hold("10:00:00", "ann", 1), ["ann"]), ("b.log", hold("10:00:01", "bob", 2), ["bob"]), ("c.log", took("10:00:02", "ann", 1), [])):
        (folder / name).write_text(text)
        sessions.into_store(sessions.watch(spark, str(folder), settle_seconds=0), root, str(tmp_path / "state"), "s", by_file=False, wait_hours=0).awaitTermination(300)
        store = Store(spark, root)
        assert [r.user for r in store.read(store.version().open["s"]).collect()] == left
    assert store.read(store.version().tables["queries_by_hours"]).count() == 0


def test_the_streamed_log_is_a_file_a_day(spark, monkeypatch):
    import pytest

    from sqlsift.plans import star_reports

    def written(lines, path):
        raise KeyError(lines.select("file").distinct().count())

    monkeypatch.setattr(star_reports, "_written", written)
    with pytest.raises(KeyError) as days:
        star_reports._streamed(spark, "/root/testdata/sf0.001")
    assert days.value.args[0] > 20


def test_the_streamed_log_keeps_numbers_like_its_host(spark, tmp_path, monkeypatch):
    import datetime

    import pytest

    from sqlsift.plans import star_reports

    def written(lines, path):
        raise KeyError([r.line for r in lines.orderBy("at").collect()])

    rows = [(no, datetime.datetime(2024, 1, 1, 10), 7, "click", 1.5, "{}") for no in (3, 10203051)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(star_reports, "_written", written)
    with pytest.raises(KeyError) as lines:
        star_reports._streamed(spark, str(tmp_path))
    assert [x.split("set ")[1] for x in lines.value.args[0]] == ["value = 3 where details = 'x'", "value = 10203051 where details = 'x'"]
