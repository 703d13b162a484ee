"""Ranges of log files: any cut gives the entries of the whole file; growing files; pairing over stretches."""

import io
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sqlsift.sources import logs, ranges

HEADS = ["2024-07-08 15:00:01 UTC:10.0.0.1(5):ann@shop:[7]:LOG:  ", "  2024-07-08 15:00:01.123 +02:[local]:é@db:[8]:LOG:  ", "2024-07-08 15:00:01 -03:30:::1(9):bob@db:[9]:ERROR:  "]
LINES = st.one_of(st.sampled_from(HEADS).map(lambda h: h + "statement: select 'ñ漢😀'"), st.sampled_from(["from t", "", "  2024-07-08 in a text", "2024-07-08", "\tx y", "duration: 1 ms"]), st.text(alphabet="aé 漢\r", max_size=8))


def whole(data: bytes):
    return list(ranges.entries_of(io.BytesIO(data), 0, len(data), True))


def cut(data: bytes, edges, exact=lambda a: a == 0, limit=None):
    out = []
    for a, b in zip(edges, edges[1:]):
        stream = io.BytesIO(data)
        stream.seek(ranges.first_read(a, exact(a)))
        out += ranges.entries_of(stream, a, b, exact(a), limit)
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(LINES, max_size=12), st.booleans(), st.lists(st.integers(0, 400), max_size=8), st.sampled_from([3, 17, 1 << 20]))
def test_any_cut_gives_the_whole(lines, closed, cuts, piece):
    data = ("\n".join(lines) + "\n" * closed).encode()
    before, ranges._PIECE = ranges._PIECE, piece
    try:
        edges = sorted({0, len(data), *[c for c in cuts if c < len(data)]})
        found = whole(data)
        assert cut(data, edges) == found
        begins = [m.start() for m in ranges._BEGIN.finditer(data)]
        assert [a for a, _ in found] == [*([0] if data and (not begins or begins[0]) else []), *begins]
        assert sum(len(t.strip()) for _, t in found) <= len(data)
    finally:
        ranges._PIECE = before


def test_every_dated_line_is_kept(spark):
    rng = random.Random(2)
    odd = ["2024-07-08 15:00:01 +02:nonsense", "2024-07-08 15:00:01 UTC:[local]:u@d:[1]:LOG:  statement: select 2", "2024-07-08 15:00:01 UTC:h(1):u@d:[1]:LOG:  duration: 1 ms", "2024-07-08 15:00:01 +0530:h(1):u@d:[1]:LOG:  duration: 2 ms  statement: select 1\n  from t", "2024-07-08 15:00:01 XYZ:h(1):u@d:[1]:LOG:  duration: 2 ms  execute <unnamed>: select 1", "2024-07-08 15:00:01 UTC:no port:u@d:[1]:LOG:  statement: select 9"]
    rows = [(str(f), "\n".join(rng.choice(odd) for _ in range(20))) for f in range(20)]
    files = spark.createDataFrame(rows, "file string, text string")
    dated = sum(line.startswith("2024") for _, t in rows for line in t.split("\n"))
    entries, bad = logs.entries(files), logs.quarantined(files)
    unparsed = bad.join(entries, ["file", "entry_no"], "left_anti").count()
    assert entries.count() + unparsed == dated and {r.entry.strip()[-8:] for r in bad.collect()} == {"nonsense", "select 1", "select 9"}
    zones = {(r.timezone, r.utc_time.hour, r.local_time.hour, r.query) for r in logs.executions(entries).withColumnsRenamed({}).select("query", "utc_time", "local_time").join(entries.select("query", "timezone"), "query").collect()}
    assert ("+0530", 9, 15, "select 1\nfrom t") in zones


def test_source_and_stream(spark, tmp_path):
    rng = random.Random(1)
    for k in range(3):
        (tmp_path / "logs").mkdir(exist_ok=True)
        (tmp_path / "logs" / f"{k}.log").write_text("lost\n" * k + "".join(rng.choice(HEADS) + f"statement: select {i} -- é漢\n  from t\n" for i in range(400)))
    (tmp_path / "logs" / "_hidden").write_text("x")
    path = str(tmp_path / "logs")
    key = lambda df: sorted(map(tuple, df.collect()))
    want = key(logs.read_logs(spark, path))
    assert len(want) == 1202 and want[0][2].startswith("2024")
    for size in (1, 997, 30_000):
        if size > 1:
            assert key(logs.read_logs(spark, path, size)) == want
    assert key(logs.read_logs(spark, "file://" + path, 5000).drop("file")) == sorted(r[1:] for r in want)
    spark.dataSource.register(ranges.LogSource)

    def step(settle):
        rows = spark.readStream.format("server_logs").option("rangeBytes", 7000).option("settleSeconds", settle).load(path)
        q = rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return key(spark.read.schema(ranges.SCHEMA).parquet(str(tmp_path / "out")))

    first = step(3600)
    assert len(first) == 1199  # the last entry of each file waits
    with (tmp_path / "logs" / "1.log").open("a") as f:
        f.write("   where x\n" + HEADS[0] + "statement: more\n")
    assert len(step(3600)) == 1200
    assert step(0) == key(logs.read_logs(spark, path))


def test_packed_file(spark, tmp_path):
    import gzip

    (tmp_path / "a.log.gz").write_bytes(gzip.compress("".join(HEADS[0] + f"statement: select {i}\n" for i in range(100)).encode()))
    assert logs.read_logs(spark, str(tmp_path), 64).count() == 100


def brute_pairs(rows):
    held, out = {}, []
    for file, no, client, kind, what in sorted(rows):
        if kind == "hold":
            held[file, client] = what
        else:
            if (file, client) in held:
                out.append((file, no, held[file, client], what))
            held.pop((file, client), None)
    return sorted(out)


@pytest.mark.parametrize("span", [1, 3, 50, 1 << 30])
def test_pairing_over_stretches(spark, span):
    rng = random.Random(span)
    rows = [(f"f{rng.randrange(2)}", k, rng.choice("aaab"), rng.choice(["hold", "duration"]), f"{k}") for k in range(300)]
    head = "file string, entry_no long, remote_host string, kind string, what string"
    df = spark.createDataFrame(rows, head).selectExpr("file", "entry_no", "remote_host", "'u' AS user", "cast(null AS string) AS database", "'LOG' AS severity", "1 AS pid", "if(kind = 'duration', what, '') AS duration_lit", "'ms' AS duration_measure", "if(kind = 'hold', what, '') AS query")
    got = sorted((r.file, r.entry_no, r.query, r.duration_lit) for r in logs.paired(df, span=span).collect())
    assert got == brute_pairs(rows)
