"""Roll-ups of executions by query, hour and user, and first-wins attributes.

Grouping is partial before the shuffle, so a fingerprint that fills a third of a log costs a row a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sqlsift.functions.ids import uuid5

CONTROL = (";", "SET", "COMMIT", "ROLLBACK")


def split_transactions(statements: DataFrame) -> DataFrame:
    """From (entry key columns, commands array, duration_us): tx_count and each statement's share of the duration."""
    n = F.size(F.filter("commands", lambda c: ~c.isin(*CONTROL)))
    out = statements.withColumn("n", n).select("*", F.explode("commands").alias("command"))
    control = F.col("command").isin(*CONTROL)
    return out.select(
        *[c for c in statements.columns if c not in ("commands", "duration_us")], "command", F.when(control, 1).otherwise(F.col("n")).cast("long").alias("tx_count"),
        F.when(control, 0).otherwise(F.round(F.col("duration_us") / F.col("n"))).cast("long").alias("duration_us"),
    )


def by_hour(runs: DataFrame, *by: str) -> DataFrame:
    """query_uid, hour, duration_us, tx_count -> queries_by_hours; further columns `by` divide it."""
    out = runs.groupBy("query_uid", "hour", *by).agg(F.count("*").alias("total_count"), F.sum("duration_us").alias("total_duration_us"), F.sum("tx_count").alias("total_queries_in_transaction"))
    return out.select(_hour_uid().alias("uid"), "query_uid", F.to_date("hour").alias("queried_date"), F.hour("hour").alias("queried_hour"), "total_count", "total_duration_us", "total_queries_in_transaction", *by)


def _hour_uid():
    return uuid5(F.concat_ws("|", "query_uid", F.date_format("hour", "yyyy-MM-dd HH:00:00")))


def by_user(runs: DataFrame, *by: str) -> DataFrame:
    """query_uid, hour, user_name, duration_us -> query_users (identity within the hour); further columns `by` divide it and bring the date."""
    out = runs.groupBy("query_uid", "hour", "user_name", *by).agg(F.count("*").alias("total_count"), F.sum("duration_us").alias("total_duration_us"))
    out = out.withColumn("queries_by_hour_uid", _hour_uid())
    return out.select(uuid5(F.concat_ws("|", "user_name", "queries_by_hour_uid")).alias("uid"), "queries_by_hour_uid", "user_name", "total_count", "total_duration_us", uuid5(F.concat_ws("|", "user_name", "query_uid")).alias("legacy_uid"), *by, *[F.to_date("hour").alias("queried_date")] * bool(by))


def first_wins(runs: DataFrame, order: str, *columns: str) -> DataFrame:
    """For each query the values of its first occurrence."""
    return runs.groupBy("query_uid").agg(F.min_by(F.struct(*columns), order).alias("x")).select("query_uid", "x.*")


def error_ranking(errors: DataFrame) -> DataFrame:
    return errors.groupBy("first_error").count().orderBy(F.desc("count"), "first_error")
