"""The reports on the stored star schema.

`REPORTS` read the tables of `load.tables` by name. The registered queries write a log of `events` (a file a day), load
it in two halves, the second with the files of the first before the gate, and report on the tables stored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlsift.functions.ids import uuid5_sql
from sqlsift.plans import load
from sqlsift.session import load as read
from sqlsift.session import shared_dir
from sqlsift.sources import logs
from sqlsift.streaming import sessions

_SECONDS = "floor(sum({us}) / 1e6 * 1000) / 1000"
_TOTALS = "cast(sum(h.total_count) AS BIGINT) AS executions, cast(sum(h.total_duration_us) AS BIGINT) AS us"
_CREATES = "{create_statements_in_queries} x JOIN {create_statements} c ON c.uid = x.create_statement_uid JOIN {queries} q ON q.uid = x.query_uid"
_TOUCHED = "{queries} q JOIN {tables_in_queries} x ON x.query_uid = q.uid JOIN {tables} t ON t.uid = x.table_uid"
#: A character class and what replaces it; [g] is the flag that some engines need to replace all.
_FAMILY = "regexp_replace(c.name, '[0-9]', ''[g])"
REPORTS = {
    "cardinalities": "SELECT " + ", ".join(f"(SELECT count(*) FROM {{{t}}}) AS {t}" for t in ("queries", "tables_in_queries", "columns_in_queries", "table_joins_in_queries", "databases", "sources", "tables")),
    "tables_joined": "SELECT count(*) AS n FROM {tables} t JOIN {tables_in_queries} x ON x.table_uid = t.uid",
    "distinct_counts": "SELECT count(DISTINCT query_uid) AS queries, count(DISTINCT table_uid) AS tables FROM {tables_in_queries}",
    "left_both_ways": "SELECT (SELECT count(*) FROM {queries} q LEFT JOIN {tables_in_queries} x ON x.query_uid = q.uid) AS of_queries, (SELECT count(*) FROM {tables_in_queries} x LEFT JOIN {queries} q ON x.query_uid = q.uid) AS of_tables",
    "queries_without_tables": f"SELECT q.masked_query, {_TOTALS} FROM {{queries}} q JOIN {{queries_by_hours}} h ON h.query_uid = q.uid LEFT JOIN {{tables_in_queries}} x ON x.query_uid = q.uid WHERE x.query_uid IS NULL GROUP BY q.masked_query ORDER BY us DESC",
    "inconsistent_names": "SELECT c.column_name, c.table_name, t.table_name AS other FROM {columns_in_queries} c JOIN {tables} t ON t.uid = c.table_uid AND t.table_name != c.table_name",
    "joined_names": "SELECT a.table_name AS name_a, b.table_name AS name_b, j.on_condition FROM {table_joins_in_queries} j JOIN {tables} a ON a.uid = j.table_uid_a JOIN {tables} b ON b.uid = j.table_uid_b",
    "tables_by_queries": "SELECT t.table_name, max(t.schema_name) AS schema_name, count(*) AS n FROM {tables_in_queries} x JOIN {tables} t ON t.uid = x.table_uid GROUP BY t.table_name ORDER BY n DESC",
    "tables_by_executions": f"SELECT t.table_name, {_TOTALS} FROM {_TOUCHED} JOIN {{queries_by_hours}} h ON h.query_uid = q.uid GROUP BY t.table_name ORDER BY us DESC",
    "queries_of_table": f"SELECT q.masked_query, q.command FROM {_TOUCHED} WHERE t.table_name = 'click'",
    "temporary_names": "SELECT c.name FROM {create_statements} c WHERE c.name LIKE 'tmp%'",
    "temporary_families": f"SELECT {_FAMILY} AS family, count(*) AS n FROM {{create_statements}} c GROUP BY 1 ORDER BY n DESC",
    "temporary_by_query": f"SELECT q.masked_query, count(*) AS n, max(c.name) AS sample FROM {_CREATES} WHERE c.name LIKE 'tmp%' GROUP BY q.masked_query",
    "temporary_by_source": f"SELECT s.name AS source, count(*) AS n FROM {_CREATES} JOIN {{sources}} s ON s.uid = q.source_uid GROUP BY s.name",
    "column_by_clause": "SELECT clause, count(*) AS n FROM {columns_in_queries} WHERE column_name = 'details' GROUP BY clause ORDER BY n DESC",
    "queries_of_column": "SELECT q.masked_query, c.clause FROM {columns_in_queries} c JOIN {queries} q ON q.uid = c.query_uid WHERE c.column_name = 'value' GROUP BY q.masked_query, c.clause",
    "joins_on_column": "SELECT q.masked_query, j.on_condition FROM {table_joins_in_queries} j JOIN {queries} q ON q.uid = j.query_uid WHERE j.on_condition ILIKE '%DETAILS%'",
    "by_database": f"SELECT d.name AS db, {_TOTALS} FROM {{queries_by_hours}} h JOIN {{queries}} q ON q.uid = h.query_uid JOIN {{databases}} d ON d.uid = q.database_uid GROUP BY d.name ORDER BY us DESC",
    "queries_of_database": f"SELECT q.masked_query, {_TOTALS} FROM {{queries_by_hours}} h JOIN {{queries}} q ON q.uid = h.query_uid JOIN {{databases}} d ON d.uid = q.database_uid WHERE d.name = 'db_1' GROUP BY q.masked_query",
    "by_command": f"SELECT q.command, {_TOTALS}, {_SECONDS.format(us='h.total_duration_us')} AS seconds, floor(sum(h.total_duration_us) / 1e3 / sum(h.total_count)) / 1000 AS average FROM {{queries_by_hours}} h JOIN {{queries}} q ON q.uid = h.query_uid WHERE q.command IN ('SELECT', 'INSERT', 'UPDATE') GROUP BY q.command ORDER BY us DESC",
    "creates_by_type": f"SELECT c.object_type, {_TOTALS} FROM {_CREATES} JOIN {{queries_by_hours}} h ON h.query_uid = q.uid GROUP BY c.object_type",
    "creates_by_family": f"SELECT {_FAMILY} AS family, {_TOTALS} FROM {_CREATES} JOIN {{queries_by_hours}} h ON h.query_uid = q.uid GROUP BY 1",
    "creates_by_query": f"SELECT q.masked_query, c.name, {_TOTALS} FROM {_CREATES} JOIN {{queries_by_hours}} h ON h.query_uid = q.uid GROUP BY q.masked_query, c.name ORDER BY us DESC",
    "by_user": "SELECT u.user_name, count(*) AS n, cast(sum(u.total_count) AS BIGINT) AS executions, cast(sum(u.total_duration_us) AS BIGINT) AS us FROM {query_users} u GROUP BY u.user_name",
    "slowest_of_user": f"SELECT q.masked_query, cast(sum(u.total_count) AS BIGINT) AS executions, {_SECONDS.format(us='u.total_duration_us')} AS seconds FROM {{query_users}} u JOIN {{queries_by_hours}} h ON h.uid = u.queries_by_hour_uid JOIN {{queries}} q ON q.uid = h.query_uid WHERE u.user_name = 'user_1' GROUP BY q.masked_query ORDER BY seconds DESC",
}


def report(spark: SparkSession, tables: dict[str, DataFrame], name: str) -> DataFrame:
    """A report on the tables of `load.tables`."""
    return spark.sql(REPORTS[name].replace("[g]", ""), **tables)


def _log_parts(s: SparkSession, d: str, host=None) -> DataFrame:
    """day, at, head, took, said: what the lines of a log of the events are made of, a join, a temporary table, a statement without tables or an update each."""
    e = read(s, d, "events")
    t, no = F.col("event_type"), F.col("event_id")
    said = (
        F.when(no % 4 == 0, F.concat(F.lit("select e.user_id, e.details from "), t, F.lit(" e join users u on e.details = u.id where e.value > "), no))
        .when(no % 4 == 1, F.concat(F.lit("create temp table tmp_"), t, F.lit("_"), no % 100, F.lit(" as select user_id from "), t, F.lit(" where value > 0")))
        .when(no % 4 == 2, F.concat(F.lit("select now(), "), no))
        .otherwise(F.concat(F.lit("update "), t, F.lit(" set value = "), no, F.lit(" where details = 'x'")))
    )
    took = (F.round(F.col("value") * 1000).cast("long") / 1000).cast("decimal(20,3)").cast("string")
    host = F.lit("10.0.0.1") if host is None else host
    head = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC:"), host, F.lit("(5432):user_"), F.col("user_id"), F.lit("@db_"), no % 3, F.lit(":[42]:LOG:  "))
    return e.select(F.date_format("ts", "yyyy-MM-dd").alias("day"), no.alias("at"), head.alias("head"), F.concat(F.lit("duration: "), took, F.lit(" ms")).alias("took"), F.concat(F.lit("statement: "), said).alias("said"))


def _log(s: SparkSession, d: str) -> DataFrame:
    """A log of the events, a file a day: its lines, with the day of each."""
    return _log_parts(s, d).select("day", "at", F.concat("head", "took", F.lit("  "), "said").alias("line"))


#: The stored tables of the log of (application, folder, events read).
_LOADED: dict[tuple, dict[str, DataFrame]] = {}


def _tables(s: SparkSession, d: str) -> dict[str, DataFrame]:
    events = sorted(map(tuple, read(s, d, "events").select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct().collect()))
    key = s.sparkContext.applicationId, d, tuple(events)
    if key not in _LOADED:
        root, lines = shared_dir(s, "star"), _log(s, d)
        path = shared_dir(s, "star-log")
        for some in (lines.filter("day < '2024-01-16'"), lines.filter("day >= '2024-01-16'")):
            some.repartition("day").sortWithinPartitions("day", "at").select("day", "line").write.mode("append").partitionBy("day").text(path)
            load.load_path(s, path, root, "app", "http://app/", range_bytes=1 << 20)
        _LOADED[key] = load.tables(s, root)
    return _LOADED[key]


_MASKED = """CASE event_id % 4
    WHEN 0 THEN '(SELECT '||event_type||'.user_id, '||event_type||'.details FROM '||event_type||' INNER JOIN users ON ('||event_type||'.details = users.id) WHERE ('||event_type||'.value > ?));'
    WHEN 1 THEN 'CREATE TEMP TABLE tmp_'||event_type||'_'||(event_id % 100)||' AS (SELECT user_id FROM '||event_type||' WHERE (value > ?));'
    WHEN 2 THEN '(SELECT now(), ?);' ELSE '(UPDATE '||event_type||' SET (value = ?) WHERE (details = ''?''));' END"""
_FIRST = uuid5_sql("first_db")
_STAR = f"""WITH ev AS (SELECT *, {uuid5_sql('masked')} AS query_uid, date_trunc('hour', ts) AS hour FROM (
    SELECT event_id, ts, event_type, event_id % 4 AS kind, 'user_'||user_id AS user_name, 'db_'||(event_id % 3) AS db, {_MASKED} AS masked, 'tmp_'||event_type||'_'||(event_id % 100) AS made,
    cast(trunc(round(value * 1000) / 1000 * 1000) AS BIGINT) AS us FROM events)),
once AS (SELECT query_uid, masked, CASE kind WHEN 1 THEN 'CREATE' WHEN 3 THEN 'UPDATE' ELSE 'SELECT' END AS command, kind, arg_min(db, (cast(ts AS DATE), event_id)) AS first_db,
    CASE WHEN kind <> 2 THEN min(event_type) END AS t, CASE WHEN kind = 1 THEN min(made) END AS made FROM ev GROUP BY query_uid, masked, kind),
queries AS (SELECT query_uid AS uid, {_FIRST} AS database_uid, command, masked AS masked_query, 1 AS source_uid FROM once),
sources AS (SELECT 1 AS uid, 'app' AS name),
databases AS (SELECT DISTINCT {_FIRST} AS uid, first_db AS name FROM once),
queries_by_hours AS (SELECT query_uid||hour AS uid, query_uid, hour, count(*) AS total_count, sum(us) AS total_duration_us FROM ev GROUP BY query_uid, hour),
query_users AS (SELECT query_uid||hour AS queries_by_hour_uid, user_name, count(*) AS total_count, sum(us) AS total_duration_us FROM ev GROUP BY query_uid, hour, user_name),
tables_in_queries AS (SELECT query_uid, t AS table_uid FROM once WHERE kind <> 2 UNION ALL SELECT query_uid, 'users' FROM once WHERE kind = 0),
tables AS (SELECT DISTINCT table_uid AS uid, table_uid AS table_name, 'public' AS schema_name FROM tables_in_queries),
columns_in_queries AS (SELECT query_uid, clause, column_name, t AS table_uid, t AS table_name FROM once JOIN (VALUES (0, 'SELECT', 'user_id'), (0, 'SELECT', 'details'), (0, 'WHERE', 'value'), (1, 'SELECT', 'user_id'), (1, 'WHERE', 'value'), (3, 'WHERE', 'details')) v(of_kind, clause, column_name) ON of_kind = kind),
table_joins_in_queries AS (SELECT query_uid, least(t, 'users') AS table_uid_a, greatest(t, 'users') AS table_uid_b, '('||t||'.details = users.id)' AS on_condition FROM once WHERE kind = 0),
create_statements AS (SELECT DISTINCT made AS uid, made AS name, 'TABLE' AS object_type FROM once WHERE kind = 1),
create_statements_in_queries AS (SELECT query_uid, made AS create_statement_uid FROM once WHERE kind = 1)
"""


_HOURS = "SELECT q.masked_query, h.queried_date, h.queried_hour, h.total_count, h.total_duration_us FROM {queries_by_hours} h JOIN {queries} q ON q.uid = h.query_uid"
_HOURS_SQL = f"""SELECT {_MASKED} AS masked_query, cast(ts AS DATE) AS queried_date, cast(extract(hour FROM ts) AS INT) AS queried_hour, count(*) AS total_count,
    cast(sum(cast(trunc(round(value * 1000) / 1000 * 1000) AS BIGINT)) AS BIGINT) AS total_duration_us FROM events GROUP BY ALL"""


def _written(lines: DataFrame, path: str) -> str:
    lines.repartition("file").sortWithinPartitions("file", "at").select("file", "line").write.partitionBy("file").text(path)
    return path


def _shared_hours(s: SparkSession, d: str) -> DataFrame:
    """Hours that many files share add up, and files read again replace what they gave: at first each duration is tenfold in half of them."""
    root, folder = shared_dir(s, "hours"), shared_dir(s, "hours-log")
    lines = _log(s, d).withColumn("file", F.col("at") % 4)
    wrong = lines.filter("file >= 2").withColumn("line", F.regexp_replace("line", r"duration: (\d+)\.", "duration: 9$1."))
    load.load_path(s, _written(lines.filter("file < 2"), f"{folder}/a"), root)
    for some in (wrong, lines.filter("file >= 2")):
        rows = logs.read_logs(s, _written(some, shared_dir(s, "hours-log")), 1 << 20).withColumn("file", F.regexp_extract("file", r"file=(\d)", 1))
        load.load(s, rows, root, reread=True)
    return s.sql(_HOURS, **load.tables(s, root))


def _streamed(s: SparkSession, d: str) -> DataFrame:
    """Statements arrive in one batch of a stream, a file a day, their durations in the next; each batch is committed to the store."""
    root, folder, state = shared_dir(s, "streamed"), shared_dir(s, "streamed-log"), shared_dir(s, "streamed-state")
    lines = _log_parts(s, d, F.concat(F.lit("10.0.0.1_"), F.col("event_id")))
    for part, text in enumerate(("said", "took")):
        _written(lines.select(F.col("day").alias("file"), "at", F.concat("head", text).alias("line")), f"{folder}/{part}")
        query = sessions.into_store(sessions.watch(s, folder, settle_seconds=0, range_bytes=4 << 20), root, state, "streamed", by_file=False)
        query.awaitTermination()
    return s.sql(_HOURS, **load.tables(s, root))


def _owners(s: SparkSession, d: str) -> DataFrame:
    """Owners of tables, imported in two documents that overlap."""
    root = shared_dir(s, "owners")
    for some in (0, 1):
        e = read(s, d, "events").filter(F.col("event_id") % 3 >= some)
        each = e.groupBy("event_type").agg(F.collect_set(F.concat(F.lit("owner_"), F.col("user_id") % 5)).alias("owners"))
        data = each.agg(F.collect_list(F.struct(F.concat(F.lit("s."), "event_type").alias("table"), "owners")).alias("data"))
        load.load_owners(s, data.select(F.lit("shop").alias("database"), "data"), root)
    return s.sql("SELECT o.name AS owner, t.schema_name, t.table_name FROM {owners_tables} x JOIN {owners} o ON o.uid = x.owner_uid JOIN {tables} t ON t.uid = x.table_uid", **load.tables(s, root))


def registry() -> dict:
    more = {
        "star_shared_hours": (_shared_hours, _HOURS_SQL),
        "stream_hours": (_streamed, _HOURS_SQL),
        "star_owners": (_owners, "SELECT DISTINCT 'owner_'||(user_id % 5) AS owner, 's' AS schema_name, event_type AS table_name FROM events"),
    }

    def sql(text: str) -> str:
        for t in load.STAYS + load.WINS:
            text = text.replace(f"{{{t}}}", t)
        return _STAR + text.replace("[g]", ", 'g'")

    return more | {f"star_{name}_report": ((lambda s, d, n=name: report(s, _tables(s, d), n)), sql(text)) for name, text in REPORTS.items()}
