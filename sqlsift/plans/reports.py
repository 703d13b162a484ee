"""Pipeline operators and report queries over a synthetic log that both engines derive from `events`.

The star schema is small CTEs over `events`: an event is an execution, its type the query's text, its user and
a third of its id the client. Totals come from queries_by_hours, where the roll-up puts them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sqlsift.functions.ids import uuid5, uuid5_sql
from sqlsift.plans import rollup
from sqlsift.session import shared_dir
from sqlsift.sources import logs

_MASKED = "'(SELECT * FROM '||event_type||' WHERE (k = ?));'"
_STAR = f"""
ex AS (SELECT event_id, ts, {_MASKED} AS masked, 'user_'||user_id AS user_name, 'db_'||(event_id % 3) AS db, 'app_'||(event_id % 5) AS source,
  event_type, cast(round(value * 1000) AS BIGINT) AS us, CASE WHEN event_id % 4 = 0 THEN 'UPDATE' WHEN event_id % 4 = 1 THEN 'INSERT' ELSE 'SELECT' END AS command FROM events),
q AS (SELECT masked AS query, min(event_type) AS tbl, min(db) AS db, min(source) AS source, min(command) AS command, count(*) AS total_count, cast(sum(us) AS BIGINT) AS total_us FROM ex GROUP BY masked),
tq AS (SELECT query, tbl AS table_name, 'public' AS schema_name FROM q WHERE tbl <> 'login'),
t AS (SELECT DISTINCT table_name, schema_name, table_name||'_'||length(table_name) AS full_name FROM tq),
cq AS (SELECT query, tbl AS table_name, 'k' AS column_name, 'WHERE' AS clause FROM q UNION ALL SELECT query, tbl, 'details', 'SELECT' FROM q),
jq AS (SELECT a.query, a.tbl AS table_a, b.tbl AS table_b, '(a.details = b.k)' AS on_condition FROM q a JOIN q b ON a.tbl < b.tbl),
c AS (SELECT DISTINCT 'tmp_'||tbl||'_'||length(tbl) AS name, 'TABLE' AS object_type, tbl FROM q),
ciq AS (SELECT q.query, c.name FROM q JOIN c ON c.tbl = q.tbl),
u AS (SELECT masked AS query, user_name, count(*) AS total_count, cast(sum(us) AS BIGINT) AS total_us FROM ex GROUP BY masked, user_name)
"""
_REPORTS = {
    "i01": "SELECT (SELECT count(*) FROM q) AS queries, (SELECT count(*) FROM tq) AS tables_in_queries, (SELECT count(*) FROM cq) AS columns_in_queries, (SELECT count(*) FROM jq) AS joins, (SELECT count(*) FROM t) AS tables",
    "i02": "SELECT count(*) AS n FROM t JOIN tq ON t.table_name = tq.table_name",
    "i03": "SELECT count(DISTINCT query) AS queries, count(DISTINCT table_name) AS tables FROM tq",
    "i04": "SELECT (SELECT count(*) FROM q LEFT JOIN tq ON q.query = tq.query) AS a, (SELECT count(*) FROM tq LEFT JOIN q ON q.query = tq.query) AS b",
    "i05": "SELECT q.query, q.total_us FROM q LEFT JOIN tq ON q.query = tq.query WHERE tq.query IS NULL ORDER BY total_us DESC",
    "i06": "SELECT t.full_name, tq.table_name FROM t JOIN tq ON t.table_name = tq.table_name AND t.full_name != tq.table_name",
    "i07": "SELECT x.full_name AS name_a, y.full_name AS name_b FROM jq JOIN t x ON x.table_name = jq.table_a JOIN t y ON y.table_name = jq.table_b",
    "i08": "SELECT table_name, max(schema_name) AS schema_name, count(*) AS n FROM tq GROUP BY table_name ORDER BY n DESC",
    "i09": "SELECT t.table_name, cast(sum(q.total_count) AS BIGINT) AS n, cast(sum(q.total_us) AS BIGINT) AS us FROM q JOIN tq ON q.query = tq.query JOIN t ON t.table_name = tq.table_name GROUP BY t.table_name ORDER BY us DESC",
    "i10": "SELECT q.query, q.total_count FROM q JOIN tq ON q.query = tq.query JOIN t ON t.table_name = tq.table_name WHERE t.table_name = 'click'",
    "i11": "SELECT name FROM c WHERE name LIKE 'tmp%'",
    "i12": "SELECT regexp_replace(name, '[0-9]', ''{G}) AS family, count(*) AS n FROM c GROUP BY 1 ORDER BY n DESC",
    "i13": "SELECT ciq.query, count(*) AS n, max(c.name) AS sample FROM ciq JOIN c ON c.name = ciq.name WHERE c.name LIKE 'tmp%' GROUP BY ciq.query",
    "i14": "SELECT q.source, count(*) AS n FROM ciq JOIN c ON c.name = ciq.name JOIN q ON q.query = ciq.query GROUP BY q.source",
    "i15": "SELECT clause, count(*) AS n FROM cq WHERE column_name = 'details' GROUP BY clause ORDER BY n DESC",
    "i16": "SELECT q.query, cq.clause FROM cq JOIN q ON q.query = cq.query WHERE cq.column_name = 'k' GROUP BY q.query, cq.clause",
    "i17": "SELECT query, on_condition FROM jq WHERE on_condition ILIKE '%DETAILS%'",
    "i18": "SELECT db, count(*) AS n, cast(sum(total_us) AS BIGINT) AS us FROM q GROUP BY db ORDER BY us DESC",
    "i19": "SELECT query, cast(sum(us) AS BIGINT) AS us FROM (SELECT masked AS query, us FROM ex WHERE db = 'db_1') z GROUP BY query",
    "i20": "SELECT command, count(*) AS n, cast(sum(us) AS BIGINT) AS us, floor(sum(us) / 1e6 * 1000) / 1000 AS seconds, floor(sum(us) / 1e3 / count(*)) / 1000 AS average FROM ex WHERE command IN ('SELECT', 'INSERT', 'UPDATE') GROUP BY command ORDER BY n DESC",
    "i21": "SELECT c.object_type, count(*) AS n, cast(sum(q.total_count) AS BIGINT) AS total FROM c JOIN ciq ON c.name = ciq.name JOIN q ON q.query = ciq.query GROUP BY c.object_type",
    "i22": "SELECT regexp_replace(c.name, '[0-9]', ''{G}) AS family, count(*) AS n, cast(sum(q.total_count) AS BIGINT) AS total FROM c JOIN ciq ON c.name = ciq.name JOIN q ON q.query = ciq.query GROUP BY 1",
    "i23": "SELECT q.query, c.name, q.total_count FROM ciq JOIN c ON c.name = ciq.name JOIN q ON q.query = ciq.query ORDER BY q.total_count DESC",
    "i24": "SELECT user_name, count(*) AS n, cast(sum(total_count) AS BIGINT) AS total, cast(sum(total_us) AS BIGINT) AS us FROM u GROUP BY user_name",
    "i25": "SELECT q.query, u.total_count, floor(u.total_us / 1e3) / 1000 AS seconds FROM u JOIN q ON q.query = u.query WHERE u.user_name = 'user_1' ORDER BY seconds DESC",
}


def _events(s, d):
    from sqlsift.session import load

    e = load(s, d, "events")
    masked = F.concat(F.lit("(SELECT * FROM "), "event_type", F.lit(" WHERE (k = ?));"))
    return e.select("event_id", F.col("ts"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), masked.alias("masked"), F.concat(F.lit("user_"), "user_id").alias("user_name"), F.concat(F.lit("db_"), F.col("event_id") % 3).alias("db"), F.round(F.col("value") * 1000).cast("long").alias("duration_us"), F.lit(1).cast("long").alias("tx_count"), uuid5(masked).alias("query_uid"))


def _written(lines, s, name: str):
    """A log written as text, a file for each `file` of (file, at, line) in the order of `at`, and read back by ranges."""
    path = shared_dir(s, name)
    lines.repartition("file").sortWithinPartitions("file", "at").select("file", "line").write.partitionBy("file").text(path)
    return logs.read_logs(s, path, 1 << 20)


def _stored(df, name: str):
    """Written and read back: what follows reads it more than once."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _prefix(host):
    return F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC:"), host, F.lit("(5432):"), "user_name", F.lit("@"), "db", F.lit(":[42]:LOG:  "))


def _took():
    return F.concat(F.lit("duration: "), (F.col("duration_us") / 1000).cast("decimal(20,3)").cast("string"), F.lit(" ms"))


def _executed(s, d, paired: bool):
    """A log of the events in four files: one entry each, or a statement and a duration apart."""
    e = _events(s, d)
    prefix, what = _prefix(F.lit("10.0.0.1")), F.concat(F.lit("execute <unnamed>: /* "), "event_id", F.lit(" */ "), "masked")
    line = F.concat(prefix, what, F.lit("\n"), prefix, _took()) if paired else F.concat(prefix, _took(), F.lit("  "), what)
    found = _written(e.select((F.col("event_id") % 4).alias("file"), F.col("event_id").alias("at"), line.alias("line")), s, "log")
    out = logs.executions(logs.paired(_stored(logs.entries(found), "entries"), span=1 << 16))  # pairing reads its rows twice
    return out.select(_number(), "local_time", "hour", F.col("user").alias("user_name"), F.col("database").alias("db"), F.regexp_replace("query", _NUMBER, "").alias("masked"), "duration_us")


_NUMBER = r"^/\* (\d+) \*/ "


def _number():
    return F.regexp_extract("query", _NUMBER, 1).cast("long").alias("event_id")


def _sessions(s, d):
    """A log file a day, many clients in each: a statement of two lines, then entries of others, then its duration. Zones are written as names and as
    distances, half of the clients are local, and some entries do not parse."""
    e = _events(s, d).withColumn("file", F.date_format("ts", "yyyy-MM-dd"))
    local, no = F.col("event_id") % 2 == 0, F.col("event_id")
    hours = F.when(no % 3 == 0, F.lit("UTC")).when(no % 3 == 1, F.lit("+00")).otherwise(F.lit("+00:00"))
    at = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss "), hours, F.lit(":"))
    # clients of this machine differ by database, here
    prefix = F.concat(at, F.when(local, F.lit("[local]")).otherwise(F.concat(F.lit("10.1.1."), no % 200, F.lit("(5432)"))), F.lit(":"), "user_name", F.lit("@"), "db", F.when(local, F.concat(F.lit("_"), no % 200)).otherwise(F.lit("")), F.lit(":[42]:LOG:  "))
    said = F.concat(F.when(no % 10 == 0, F.concat(at, F.lit("out of memory\n"))).otherwise(F.lit("")), prefix, F.lit("statement: /* "), no, F.lit(" */ "), "masked", F.lit("\n   ;"))
    lines = e.select("file", F.explode(F.array(F.struct((2 * no).alias("at"), said.alias("line")), F.struct((2 * no + 7).alias("at"), F.concat(prefix, _took()).alias("line")))).alias("x")).select("file", "x.*")
    out = logs.executions(logs.paired(_stored(logs.entries(_written(lines, s, "sessions")), "entries"), span=1 << 16))
    return out.select(_number(), F.regexp_replace("query", _NUMBER, "").alias("query"), F.col("user").alias("user_name"), F.regexp_extract("database", r"^db_\d", 0).alias("db"), "hour", "duration_us")


def _quarantined(s, d):
    """What a log of the events has of entries that do not parse, unknown zones and unreadable times, by file."""
    e = _events(s, d)
    at = F.date_format("ts", "yyyy-MM-dd HH:mm:ss ")
    kind = F.col("event_id") % 5
    rest = F.concat(F.lit("10.0.0.1(1):u@d:[42]:LOG:  duration: 1 ms  statement: select "), "event_id")
    line = F.when(kind == 0, F.concat(at, F.lit("UTC:10.0.0.1:u@d: no port "), "event_id")).when(kind == 1, F.concat(at, F.lit("QQQ:"), rest)).when(kind == 2, F.concat(F.date_format("ts", "yyyy-99-dd HH:mm:ss "), F.lit("UTC:"), rest)).when(kind == 3, F.concat(at, F.lit("-00:30:"), rest)).otherwise(F.concat(at, F.lit("UTC:"), rest))
    found = _written(e.select((F.col("event_id") % 4).alias("file"), F.col("event_id").alias("at"), line.alias("line")), s, "bad")
    return logs.quarantined(found).select(F.regexp_extract("entry", r"(\d+)\s*$", 1).cast("long").alias("event_id"), F.regexp_extract("file", r"file=(\d)", 1).cast("int").alias("file"))


def _star(s, d, name):
    """A table of the star schema, parsed from a log of the events: one statement each, in a file a day."""
    from sqlsift.plans import ingest

    e = _events(s, d)
    kind = F.regexp_extract("masked", r"FROM (\w+)", 1)
    said = F.concat(F.lit("select e.user_id, lower(x) from "), kind, F.lit(" e where e.value > "), F.col("event_id"))
    line = F.concat(_prefix(F.lit("10.0.0.1")), _took(), F.lit("  statement: "), said)
    found = _written(e.select(F.date_format("ts", "yyyy-MM-dd").alias("file"), F.col("event_id").alias("at"), line.alias("line")), s, "star-log")
    runs = _stored(logs.executions(logs.paired(_stored(logs.entries(found), "entries"))), "runs")
    return ingest.star(runs, _stored(ingest.analyzed(runs), "texts"))[name]


_EX = f"SELECT event_id, date_trunc('second', ts) AS local_time, date_trunc('hour', ts) AS hour, 'user_'||user_id AS user_name, 'db_'||(event_id % 3) AS db, {_MASKED} AS masked, cast(round(value * 1000) AS BIGINT) AS duration_us FROM events"
_QH = f"WITH e AS (SELECT *, {uuid5_sql('masked')} AS query_uid FROM ({_EX})) "
_HOUR = uuid5_sql("query_uid||'|'||strftime(hour, '%Y-%m-%d %H:00:00')")


def _tx(s, d):
    e = _events(s, d)
    kinds = F.when(F.col("event_id") % 3 == 0, F.array(F.lit("BEGIN"), F.lit("UPDATE"), F.lit("COMMIT"))).when(F.col("event_id") % 3 == 1, F.array(F.lit("SET"))).otherwise(F.array(F.lit("SELECT"), F.lit("SELECT")))
    return rollup.split_transactions(e.select("event_id", kinds.alias("commands"), "duration_us")).groupBy("command").agg(F.count("*").alias("n"), F.sum("tx_count").alias("tx"), F.sum("duration_us").alias("us"))


def registry():
    from sqlsift.session import with_views

    out = {}
    for name, text in _REPORTS.items():
        sql = f"WITH {_STAR} {text}"
        out[f"report_{name}"] = ((lambda s, d, q=sql.replace("{G}", ""): with_views(s, d).sql(q)), sql.replace("{G}", ", 'g'"))
    read_back = _EX.replace("cast(round(value * 1000) AS BIGINT)", "cast(trunc(round(value * 1000) / 1000 * 1000) AS BIGINT)")  # the unit conversion truncates
    out["log_roundtrip"] = (lambda s, d: _executed(s, d, False), read_back)
    out["log_quarantine"] = (_quarantined, "SELECT event_id, cast(event_id % 4 AS INT) AS file FROM events WHERE event_id % 5 < 3")
    out["log_pairing"] = (lambda s, d: _executed(s, d, True), read_back)
    out["log_sessions"] = (_sessions, f"SELECT event_id, masked || chr(10) || ';' AS query, user_name, db, hour, duration_us FROM ({read_back})")
    text = "'(SELECT '||event_type||'.user_id, lower(x) FROM '||event_type||' WHERE ('||event_type||'.value > ?));'"
    parsed = f"WITH e AS (SELECT *, {uuid5_sql(text)} AS query_uid, 'public.'||event_type AS full_name FROM events) "
    out["star_queries"] = (lambda s, d: _star(s, d, "queries").select("uid", "command", "masked_query"), parsed + f"SELECT DISTINCT query_uid AS uid, 'SELECT' AS command, {text} AS masked_query FROM e")
    out["star_databases"] = (lambda s, d: _star(s, d, "databases"), "SELECT DISTINCT " + uuid5_sql("'db_'||(arg_min(event_id, ts_day) % 3)").replace("arg_min(event_id, ts_day)", "first_id") + " AS uid, 'db_'||(first_id % 3) AS name FROM (SELECT event_type, arg_min(event_id, (cast(ts AS DATE), event_id)) AS first_id FROM events GROUP BY event_type)")
    out["star_tables"] = (lambda s, d: _star(s, d, "tables"), "SELECT DISTINCT " + uuid5_sql("'public.'||event_type") + " AS uid, 'public' AS schema_name, event_type AS table_name FROM events")
    out["star_tables_in_queries"] = (lambda s, d: _star(s, d, "tables_in_queries").select("query_uid", "table_uid", "command"), parsed + "SELECT DISTINCT query_uid, " + uuid5_sql("full_name") + " AS table_uid, 'SELECT' AS command FROM e")
    out["star_columns"] = (lambda s, d: _star(s, d, "columns_in_queries").groupBy("clause", "table_name", "column_name").count(), "SELECT clause, event_type AS table_name, column_name, count(*) AS count FROM (SELECT DISTINCT event_type FROM events), (VALUES ('SELECT', 'user_id'), ('SELECT', 'x'), ('WHERE', 'value')) v(clause, column_name) GROUP BY ALL")
    out["star_functions"] = (lambda s, d: _star(s, d, "functions_in_queries"), parsed + "SELECT DISTINCT query_uid, 'lower' AS function_name FROM e")
    out["star_hours"] = (lambda s, d: _star(s, d, "queries_by_hours").select("query_uid", "queried_date", "queried_hour", "total_count", "total_duration_us"), parsed + "SELECT query_uid, cast(ts AS DATE) AS queried_date, cast(extract(hour FROM ts) AS INT) AS queried_hour, count(*) AS total_count, cast(sum(cast(trunc(round(value * 1000) / 1000 * 1000) AS BIGINT)) AS BIGINT) AS total_duration_us FROM e GROUP BY ALL")
    out["hour_rollup"] = (lambda s, d: rollup.by_hour(_events(s, d)), _QH + f"SELECT {_HOUR} AS uid, * FROM (SELECT query_uid, cast(hour AS DATE) AS queried_date, cast(extract(hour FROM hour) AS INT) AS queried_hour, count(*) AS total_count, cast(sum(duration_us) AS BIGINT) AS total_duration_us, count(*) AS total_queries_in_transaction, hour FROM e GROUP BY query_uid, hour)".replace("SELECT " + _HOUR + " AS uid, *", f"SELECT {_HOUR} AS uid, query_uid, queried_date, queried_hour, total_count, total_duration_us, total_queries_in_transaction"))
    hour_users = _QH + f"SELECT {uuid5_sql('user_name||' + chr(39) + '|' + chr(39) + '||h')} AS uid, h AS queries_by_hour_uid, user_name, n AS total_count, us AS total_duration_us, {uuid5_sql('user_name||' + chr(39) + '|' + chr(39) + '||query_uid')} AS legacy_uid FROM (SELECT query_uid, hour, user_name, {_HOUR} AS h, count(*) AS n, cast(sum(duration_us) AS BIGINT) AS us FROM e GROUP BY query_uid, hour, user_name)"
    out["user_rollup"] = (lambda s, d: rollup.by_user(_events(s, d)), hour_users)
    out["fingerprint_uuid5"] = (lambda s, d: _events(s, d).select("event_id", "query_uid"), f"SELECT event_id, {uuid5_sql(_MASKED)} AS query_uid FROM events")
    out["sha1"] = (lambda s, d: _events(s, d).select("event_id", F.sha1(F.col("masked").cast("binary")).alias("h")), f"SELECT event_id, sha1({_MASKED}) AS h FROM events")
    out["first_wins"] = (lambda s, d: rollup.first_wins(_events(s, d), "event_id", "db", "user_name"), _QH + "SELECT query_uid, arg_min(db, event_id) AS db, arg_min(user_name, event_id) AS user_name FROM e GROUP BY query_uid")
    out["error_rank"] = (lambda s, d: rollup.error_ranking(_events(s, d).select(F.concat(F.lit("no prefix function for "), "db").alias("first_error"))), "SELECT 'no prefix function for db_'||(event_id % 3) AS first_error, count(*) AS count FROM events GROUP BY 1")
    out["tx_split"] = (_tx, "WITH e AS (SELECT event_id, cast(round(value * 1000) AS BIGINT) AS us FROM events), s AS (SELECT 'BEGIN' AS command, 2 AS tx, round(us / 2) AS us FROM e WHERE event_id % 3 = 0 UNION ALL SELECT 'UPDATE', 2, round(us / 2) FROM e WHERE event_id % 3 = 0 UNION ALL SELECT 'COMMIT', 1, 0 FROM e WHERE event_id % 3 = 0 UNION ALL SELECT 'SET', 1, 0 FROM e WHERE event_id % 3 = 1 UNION ALL SELECT 'SELECT', 2, round(us / 2) FROM e, range(2) WHERE event_id % 3 = 2) SELECT command, count(*) AS n, cast(sum(tx) AS BIGINT) AS tx, cast(sum(us) AS BIGINT) AS us FROM s GROUP BY command")
    return out
