"""Executions to the star schema: each distinct text is parsed once, its statements join back to the executions.

The join's key may be hot (one text can fill a third of a log): AQE splits such partitions, and what follows
aggregates before it shuffles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sqlsift.functions.analyze import analyze
from sqlsift.functions.ids import uuid5
from sqlsift.plans import rollup


def analyzed(executions: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """query, error, statements of each distinct text that `known` (query) lacks. Texts are few bytes and much work: a count of partitions keeps AQE from parsing them in one task."""
    parts = max(int(executions.sparkSession.conf.get("spark.sql.shuffle.partitions")), executions.sparkSession.sparkContext.defaultParallelism)
    texts = executions.select("query").distinct()
    if known is not None:
        texts = texts.join(known.select("query"), "query", "left_anti")
    return texts.repartition(parts, "query").withColumn("a", analyze("query")).select("query", "a.error", "a.statements")


def statements(executions: DataFrame, texts: DataFrame) -> DataFrame:
    """One row per executed statement, with its share of the duration; texts in error have none."""
    good = texts.filter("error is null").select("query", F.col("statements.command").alias("commands"), "statements")
    n = F.size(F.filter("commands", lambda c: ~c.isin(*rollup.CONTROL)))
    rows = executions.join(good, "query").withColumn("n", n).select("*", F.posexplode("statements").alias("statement_no", "s"))
    control = F.col("s.command").isin(*rollup.CONTROL)
    return rows.select(
        uuid5(F.col("s.masked")).alias("query_uid"), F.col("s.command").alias("command"), F.col("s.masked").alias("masked_query"), F.col("s.unmasked").alias("unmasked_query"), "query",
        F.col("database").alias("database_name"), F.col("user").alias("user_name"), "hour", F.struct("file", "entry_no", "statement_no").alias("seen"), *[c for c in ("origin",) if c in rows.columns], F.when(control, 1).otherwise(F.col("n")).cast("long").alias("tx_count"),
        F.when(control, 0).otherwise(F.round(F.col("duration_us") / F.col("n"))).cast("long").alias("duration_us"),
    )


def _once(texts: DataFrame) -> DataFrame:
    """query_uid and statement, one for each query, of the texts that parse.

    Statements are chosen by the least hash of their text and place, so what is grouped are two small columns (uid, number) by hashing, not all
    statements by sorting. `texts` is read twice.
    """
    good = texts.filter("error is null").select("query", F.posexplode("statements").alias("no", "s"))
    said = good.select(uuid5(F.col("s.masked")).alias("query_uid"), F.xxhash64("query", "no").alias("place"), "s")
    least = said.groupBy("query_uid").agg(F.min("place").alias("place"))
    return said.join(least, ["query_uid", "place"]).select("query_uid", "s.*").dropDuplicates(["query_uid"])


def _uid(*parts):
    return uuid5(F.concat_ws("|", *parts))


def star(executions: DataFrame, texts: DataFrame, kept=lambda rows, name: rows) -> dict[str, DataFrame]:
    """The tables of the star schema; `texts` is `analyzed(executions)`, best written once before. `kept` may write what several tables are made of, and give what it wrote."""
    runs = statements(executions, texts)
    first = kept(rollup.first_wins(runs, "seen", "database_name", "command", "masked_query", "unmasked_query"), "first")
    queries = first.select(F.col("query_uid").alias("uid"), uuid5(F.col("database_name")).alias("database_uid"), "command", "masked_query", "unmasked_query", "database_name")
    each = kept(_once(texts), "each")
    table = lambda t: F.concat_ws(".", *t)

    def part(name):
        return each.select("query_uid", "command", F.explode(name).alias("x")).select("query_uid", "command", "x.*")

    named = table(["schema_name", "table_name"])
    tables = part("tables").withColumn("table_uid", uuid5(named))
    columns = part("columns").withColumn("table_uid", uuid5(named)).withColumn("column_uid", uuid5(table(["schema_name", "table_name", "column_name"])))
    joins = part("joins").withColumn("table_uid_a", uuid5(table(["schema_a", "table_a"]))).withColumn("table_uid_b", uuid5(table(["schema_b", "table_b"])))
    made = ["scope", "is_unique", "is_temp", "is_unlogged", "object_type", "name", "expression", "where_clause"]
    creates = part("creates").withColumn("uid", _uid(*[F.col(c).cast("string") for c in made]))
    return {
        "queries": queries.drop("database_name"),
        "databases": queries.select(F.col("database_uid").alias("uid"), F.col("database_name").alias("name")).distinct(),
        "queries_by_hours": rollup.by_hour(runs),
        "query_users": rollup.by_user(runs),
        "tables": tables.select(F.col("table_uid").alias("uid"), "schema_name", "table_name").distinct(),
        "tables_in_queries": tables.withColumn("uid", _uid("query_uid", "table_uid")),
        "columns_in_queries": columns.withColumn("uid", _uid("query_uid", "clause", table(["schema_name", "table_name", "column_name"]))),
        "table_joins_in_queries": joins.withColumn("uid", _uid("query_uid", "table_uid_a", "table_uid_b")),
        "functions_in_queries": each.select("query_uid", F.explode("functions").alias("function_name")),
        "create_statements": creates.drop("query_uid", "command").dropDuplicates(["uid"]),
        "create_statements_in_queries": creates.select(_uid("query_uid", "uid").alias("uid"), "query_uid", F.col("uid").alias("create_statement_uid")),
        "errors": rollup.error_ranking(executions.join(texts.filter("error is not null"), "query").select(F.col("error").alias("first_error"))),
    }


def shares(runs: DataFrame) -> dict[str, DataFrame]:
    """The roll-ups of statements with an `origin`, by origin; uid is that of the total."""
    hours = rollup.by_hour(runs, "origin")
    users = rollup.by_user(runs, "origin")
    return {"hour_shares": hours, "user_shares": users}


def owners(imported: DataFrame, existing: DataFrame) -> dict[str, DataFrame]:
    """Owners of tables from {database, data: [{table, owners}]}, and the tables that `existing` (uid) lacks."""
    rows = imported.select("database", F.explode("data").alias("d")).select("database", F.split("d.table", r"\.").alias("p"), F.explode("d.owners").alias("owner"))
    size = F.size("p")
    rows = rows.withColumn("schema_name", F.when(size == 2, F.get("p", F.lit(0))).otherwise("public")).withColumn("table_name", F.when(size <= 2, F.get("p", size - 1)).otherwise(""))
    rows = rows.withColumn("table_uid", uuid5(F.concat_ws(".", "schema_name", "table_name"))).withColumn("owner_uid", uuid5(F.col("owner")))
    tables = rows.select(F.col("table_uid").alias("uid"), uuid5(F.col("database")).alias("database_uid"), "schema_name", "table_name", F.lit("owners_import").alias("table_type"), F.lit(-1).cast("long").alias("estimated_row_count"))
    return {
        "owners": rows.select(F.col("owner_uid").alias("uid"), F.col("owner").alias("name")).distinct(),
        "owners_tables": rows.select(uuid5(F.concat("owner_uid", "table_uid")).alias("uid"), "owner_uid", "table_uid").distinct(),
        "tables": tables.dropDuplicates(["uid"]).join(existing.select("uid"), "uid", "left_anti"),
    }


def _texts(spark, sf_dir):
    from sqlsift.session import with_views

    text = "'select e.user_id, count(*) from '||event_type||' e join users u on e.user_id = u.id where e.value > '||event_id||' group by e.user_id'"
    ex = with_views(spark, sf_dir).sql(f"SELECT {text} AS query FROM events")
    return analyzed(ex).select("query", F.explode("statements").alias("s"))


def registry():
    """Front-end queries over texts derived from `events`, with the expected results as SQL."""
    t = "event_type"
    query = "'select e.user_id, count(*) from '||event_type||' e join users u on e.user_id = u.id where e.value > '||event_id||' group by e.user_id'"
    masked = f"'(SELECT '||{t}||'.user_id, count(*) FROM '||{t}||' INNER JOIN users ON ('||{t}||'.user_id = users.id) WHERE ('||{t}||'.value > ?) GROUP BY '||{t}||'.user_id);'"
    sides = f"least('public.'||{t}, 'public.users')", f"greatest('public.'||{t}, 'public.users')"
    return {
        "masked_text": (lambda s, d: _texts(s, d).select("query", "s.masked"), f"SELECT {query} AS query, {masked} AS masked FROM events"),
        "extract_columns": (
            lambda s, d: _texts(s, d).select(F.explode("s.columns").alias("c")).groupBy("c.clause", "c.table_name", "c.column_name").count(),
            f"SELECT clause, {t} AS table_name, column_name, count(*) AS count FROM events, (VALUES ('SELECT', 'user_id'), ('WHERE', 'value'), ('GROUP_BY', 'user_id')) v(clause, column_name) GROUP BY ALL",
        ),
        "extract_tables": (lambda s, d: _texts(s, d).select(F.explode("s.tables").alias("c")).groupBy("c.table_name").count(), f"SELECT table_name, count(*) AS count FROM (SELECT {t} AS table_name FROM events UNION ALL SELECT 'users' FROM events) GROUP BY 1"),
        "extract_joins": (
            lambda s, d: _texts(s, d).select(F.explode("s.joins").alias("c")).select(F.concat_ws(".", "c.schema_a", "c.table_a").alias("a"), F.concat_ws(".", "c.schema_b", "c.table_b").alias("b"), "c.on_condition", "c.join_condition").groupBy("a", "b", "on_condition", "join_condition").count(),
            f"SELECT {sides[0]} AS a, {sides[1]} AS b, '('||{t}||'.user_id = users.id)' AS on_condition, 'INNER JOIN' AS join_condition, count(*) AS count FROM events GROUP BY ALL",
        ),
    }
