"""Tables of databases by JDBC, and staged JSON documents."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def bounds(spark: SparkSession, url: str, table: str, column: str, **options: str) -> tuple | None:
    """Least and largest value of a column, asked of the database; None if there are none."""
    q = f'SELECT min({_quoted(column)}) AS {_quoted("lo")}, max({_quoted(column)}) AS {_quoted("hi")} FROM {table}'
    found = spark.read.format("jdbc").option("url", url).option("query", q).options(**options).load().first()
    return (found[0], found[1]) if found[0] is not None else None


def read_table(spark: SparkSession, url: str, table: str, column: str | None = None, parts: int = 8, **options: str) -> DataFrame:
    """A table by JDBC, in `parts` ranges of a numeric, date or time column if one is named; filters and columns are pushed to the database.

    The ranges lie between the least and the largest value that the table has now; rows that come later are in the outer ones.
    """
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    ends = bounds(spark, url, table, column, **options) if column else None
    if ends:
        reader = reader.option("partitionColumn", column).option("lowerBound", str(ends[0])).option("upperBound", str(ends[1])).option("numPartitions", parts)
    return reader.load()


def write_table(df: DataFrame, url: str, table: str, parts: int = 8, mode: str = "append", **options: str) -> None:
    """Rows into a table by JDBC, through `parts` connections at most."""
    df.coalesce(parts).write.format("jdbc").option("url", url).option("dbtable", table).option("batchsize", 10_000).options(**options).mode(mode).save()


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _in_one(spark: SparkSession, url: str, statements: list[str], **options: str) -> None:
    """Statements in one transaction of the database."""
    jvm = spark.sparkContext._jvm
    given = jvm.java.util.Properties()
    for k, v in options.items():
        given.setProperty(k, v)
    if "driver" in options:
        jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(options["driver"])
    link = jvm.java.sql.DriverManager.getConnection(url, given)
    try:
        link.setAutoCommit(False)
        for text in statements:
            s = link.createStatement()
            s.executeUpdate(text)
            s.close()
        link.commit()
    except Exception:
        link.rollback()
        raise
    finally:
        link.close()


def merge_table(df: DataFrame, url: str, table: str, key: str = "uid", wins: bool = True, parts: int = 8, tries: int = 3, **options: str) -> None:
    """Merges rows into a table of a database by key: the new row `wins`, or the old one stays; rows of new keys are added.

    The rows go to a table of their own through `parts` connections; one MERGE in one transaction then takes all of them or none. A failed attempt leaves
    the table as it was and can be repeated, which is done `tries` times in all. Of several rows with one key one is taken; rows without a key are left out.
    """
    spark, names = df.sparkSession, df.columns
    rows = df.filter(F.col(key).isNotNull()).dropDuplicates([key])
    others = [c for c in names if c != key]
    listed = ", ".join(map(_quoted, names))
    for attempt in range(1, tries + 1):
        aside = f"{table}_{uuid.uuid4().hex[:12]}"
        merge = f"MERGE INTO {table} t USING {aside} s ON t.{_quoted(key)} = s.{_quoted(key)}"
        merge += f" WHEN MATCHED THEN UPDATE SET {', '.join(f'{_quoted(c)} = s.{_quoted(c)}' for c in others)}" if wins and others else ""
        merge += f" WHEN NOT MATCHED THEN INSERT ({listed}) VALUES ({', '.join(f's.{_quoted(c)}' for c in names)})"
        try:
            _in_one(spark, url, [f"CREATE TABLE {aside} AS SELECT {listed} FROM {table} WITH NO DATA"], **options)
            try:
                write_table(rows, url, aside, parts, **options)
                _in_one(spark, url, [merge], **options)
                return
            finally:
                _in_one(spark, url, [f"DROP TABLE {aside}"], **options)
        except Py4JJavaError:
            if attempt == tries:
                raise


def read_staged(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """The objects of a staged JSON document {name: {uid: {...}}}, one row each; `schema` is that of an object."""
    rows = spark.read.schema(f"`{name}` map<string, struct<{schema}>>").json(path, multiLine=True)
    return rows.select(F.explode(name).alias("key", "value")).select("key", "value.*")


def write_staged(df: DataFrame, path: str) -> None:
    """One JSON object a line."""
    df.write.mode("errorifexists").json(path)
