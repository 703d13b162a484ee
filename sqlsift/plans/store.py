"""Stored tables that change by keys: buckets of a table, merges that rewrite only what changes, versions committed by manifests.

A table is a set of folders, a few for each bucket. A bucket is the rows whose `uid` begins with the same hexadecimal digits (none for
a small table, one more each time the table has outgrown its buckets) and, for tables with a date, are of one date: so its name
bounds its keys, and a merge reads the keys of those buckets alone that new rows fall in. New keys become a further folder; a folder is
rewritten if it holds a row that changes or goes. A bucket of many folders is made one again when it is touched.

A version is a manifest, a JSON file named by its number, that lists the folders of every table. It is written beside and then given its
name, which fails if another load has taken the number: of two loads from one base one commits, the other starts again from the winner's version. Nothing is
ever overwritten, so readers of a version are not disturbed; `expire` removes what no kept version names. The file system must
be able to rename or link a file to a name that is not taken in one step (local ones, HDFS).
"""

from __future__ import annotations

import json
import os
import time
import uuid
from dataclasses import dataclass, field
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY = "uid"
#: Rows of a bucket from which a table gets more buckets; folders of a bucket that are made one.
FULL, MANY = 1_000_000, 8


def folder_of(path):
    """The folder (data/table/load/bucket) of a file, by its path. Cut at slashes: a pattern without a fixed begin is tried at every letter of every row's path."""
    return F.substring_index(F.substring_index(path, "/", -5), "/", 4)


def observed(rows: DataFrame, path: str, *by: str, same: str | Column | None = None, spread: bool = True) -> tuple[int, int]:
    """Writes rows, in folders `by` columns, dealt by these anew unless not `spread`; how many there are and how many of them are `same`, counted by the write."""
    seen = Observation()
    aggregates = F.count(F.lit(1)).alias("n"), F.lit(0).alias("same") if same is None else F.count_if(same).alias("same")
    out = rows.observe(seen, aggregates[0]) if same is None else rows.observe(seen, *aggregates)
    (out.hint("rebalance", *by) if by and spread else out).write.partitionBy(*by).parquet(path)
    try:
        found = seen.get
    except Py4JJavaError:  # a plan that is found to be empty loses its metrics
        found = rows.sparkSession.read.schema(rows.schema).parquet(path).agg(*aggregates).first()
    return found["n"], 0 if same is None else found["same"]


@dataclass
class Table:
    """What a manifest says of a table: its schema, digits of its keys and date column that make a bucket, folders and rows of each bucket."""

    schema: str
    digits: int = 0
    date: str | None = None
    folders: dict[str, list[str]] = field(default_factory=dict)
    rows: dict[str, int] = field(default_factory=dict)


@dataclass
class Version:
    number: int = 0
    tables: dict[str, Table] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)
    counts: dict[str, int] = field(default_factory=dict)
    at: float = 0.0
    open: dict[str, Table] = field(default_factory=dict)  # by stream, statements that wait for their durations


class Store:
    """The tables below `root`."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return [s.getPath().getName() for s in self._fs.listStatus(path)] if self._fs.exists(path) else []

    # versions

    def numbers(self) -> list[int]:
        """Numbers of the versions there are."""
        return sorted(int(n[:-5]) for n in self._names("manifests") if n.endswith(".json") and n[0] not in "._")

    def version(self, number: int | None = None) -> Version:
        """A version, the last by default; an empty one before the first commit."""
        number = max(self.numbers(), default=0) if number is None else number
        if not number:
            return Version()
        stream = self._fs.open(self._path(f"manifests/{number:012}.json"))
        try:
            found = json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return Version(number, {k: Table(**t) for k, t in found["tables"].items()}, found["batches"], found["counts"], found["at"], {k: Table(**t) for k, t in found.get("open", {}).items()})

    def commit(self, base: Version, tables: dict[str, Table], counts: dict[str, int], batch: tuple[str, int] | None = None, waiting: Table | None = None) -> bool:
        """Makes `tables` the version after `base`, and `waiting` what is open of the batch's stream; False if another load was first."""
        waits = {**base.open, **({batch[0]: waiting} if batch and waiting else {})}
        made = {"tables": {k: vars(t) for k, t in {**base.tables, **tables}.items()}, "batches": {**base.batches, **({batch[0]: batch[1]} if batch else {})}, "counts": counts, "at": time.time(), "open": {k: vars(t) for k, t in waits.items()}}
        self._fs.mkdirs(self._path("manifests"))
        aside, name = self._path(f"manifests/.{uuid.uuid4().hex}"), self._path(f"manifests/{base.number + 1:012}.json")
        stream = self._fs.create(aside, False)
        stream.write(bytearray(json.dumps(made).encode()))
        stream.close()
        try:
            if self._fs.getUri().getScheme() == "file":
                os.link(aside.toUri().getPath(), name.toUri().getPath())  # its rename would replace
            else:
                context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
                options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
                options[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.NONE
                context.rename(aside, name, options)
            return True
        except FileExistsError:
            return False
        except Exception as e:
            if "AlreadyExists" in str(e):
                return False
            raise
        finally:
            self._fs.delete(aside, False)

    # tables

    def read(self, table: Table, buckets: set[str] | None = None) -> DataFrame:
        """Rows of a table, of some buckets if named."""
        paths = [f"{self.root}/{f}" for b, folders in sorted(table.folders.items()) if buckets is None or b in buckets for f in folders]
        kind = T.StructType.fromJson(json.loads(table.schema))
        return self.spark.read.schema(kind).parquet(*paths) if paths else self.spark.createDataFrame([], kind)

    def _bucket(self, table: Table):
        digits = F.substring(F.coalesce(KEY, F.lit("")), 1, table.digits) if table.digits else F.lit("")
        return F.concat_ws(".", F.coalesce(F.col(table.date).cast("string"), F.lit("none")), digits) if table.date else F.concat(F.lit("all"), digits)

    def _write(self, rows: DataFrame, folder: str) -> tuple[dict[str, str], int]:
        """Rows with a bucket as a folder each: the folder's name by bucket, and how many rows there are."""
        n, _ = observed(rows, f"{self.root}/{folder}", "bucket")
        return {name.split("=", 1)[1]: f"{folder}/{name}" for name in self._names(folder) if name.startswith("bucket=")}, n

    def _touched(self, table: Table, rows: DataFrame) -> set[str]:
        """The table's buckets that rows with a bucket fall in."""
        if not table.digits and not table.date:
            return set(table.folders)
        return {r.bucket for r in rows.select("bucket").distinct().collect()} & set(table.folders)

    def matched(self, table: Table | None, keys: DataFrame) -> DataFrame | None:
        """The rows of a table whose uid is among `keys` (the columns that make its buckets); None if the table has none of their buckets."""
        if table is None or not table.folders:
            return None
        asked = self._touched(table, keys.withColumn("bucket", self._bucket(table)))
        return self.read(table, asked).join(keys.select(KEY).distinct(), KEY, "left_semi") if asked else None

    def merge(self, table: Table | None, new: DataFrame, wins: bool, folder: str, date: str | None = None, gone: DataFrame | None = None, rows: int | None = None) -> Table:
        """The table with the rows of `new` (written tables, best: they are read several times), and without those of `gone` (uid, date).

        Of several new rows with one uid one is taken. Of an old and a new one the old stays, or the new `wins`. Rows that
        are there already as they are change nothing. New columns are null in old rows. `folder` is one that no other merge writes to; `rows` the
        number of rows of `new`, if it is known.
        """
        one = new.dropDuplicates([KEY])
        rows = new.count() if rows is None else rows
        if table is None:
            table = Table(new.schema.json(), 0, date)
            # each date is a bucket already, so what is divided further is a date's share
            dates = max(1, new.select(date).distinct().count()) if date and rows > FULL else 1
            while rows > FULL * dates * 16**table.digits:
                table.digits += 1
        else:
            old = T.StructType.fromJson(json.loads(table.schema))
            more = [f for f in new.schema.fields if f.name not in old.fieldNames()]
            table = Table(T.StructType([*old.fields, *more]).json(), table.digits, table.date, {b: [*f] for b, f in table.folders.items()}, dict(table.rows))
            table = self._split_up(table, f"{folder}-split")
        kind = T.StructType.fromJson(json.loads(table.schema))
        columns = kind.fieldNames()
        have = set(new.columns)
        one = one.select(*[F.col(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in kind.fields])
        if not table.folders:
            return self._added(table, one.withColumn("bucket", self._bucket(table)), folder)
        keys = one.select(KEY, self._bucket(table).alias("bucket"), (F.xxhash64(*columns) if wins else F.lit(0)).alias("content"), F.lit(False).alias("gone"))
        if gone is not None:
            gone = gone.join(one.select(KEY), KEY, "left_anti")
            keys = keys.unionByName(gone.select(KEY, self._bucket(table).alias("bucket"), F.lit(None).cast("long").alias("content"), F.lit(True).alias("gone")))
        touched = self._touched(table, keys)
        if not touched:
            return self._added(table, one.withColumn("bucket", self._bucket(table)), folder)
        old = self.read(table, touched).select(F.col(KEY).alias("k"), (F.xxhash64(*columns) if wins else F.lit(0)).alias("was"), folder_of("_metadata.file_path").alias("folder"))
        met = old.join(keys, F.col("k") == F.col(KEY)).select(KEY, "bucket", "folder", "gone", (F.col("was") == F.col("content")).alias("same"))
        matched, same = observed(met, f"{self.root}/{folder}-met", same="same")
        met = self.spark.read.schema("uid string, bucket string, folder string, gone boolean, same boolean").parquet(f"{self.root}/{folder}-met")
        if same < rows:
            table = self._added(table, (one.join(met.filter("same"), KEY, "left_anti") if same else one).withColumn("bucket", self._bucket(table)), folder)
        change = [(r.bucket, r.folder, r.n) for r in met.filter("not coalesce(same, false)").groupBy("bucket", "folder").agg(F.countDistinct(KEY).alias("n")).collect()] if matched > same else []
        crowded = {b for b, f in table.folders.items() if len(f) > MANY}
        if change or crowded:
            table = self._rewritten(table, {b for b, _, _ in change}, {f for _, f, _ in change}, crowded, met.filter("not coalesce(same, false)"), folder, {b: sum(n for c, _, n in change if c == b) for b, _, _ in change})
        self._fs.delete(self._path(f"{folder}-met"), True)
        return table

    def _added(self, table: Table, rows: DataFrame, folder: str) -> Table:
        folders, n = self._write(rows, folder)
        for b, f in folders.items():
            table.folders.setdefault(b, []).append(f)
        if len(folders) < 2:
            for b in folders:
                table.rows[b] = table.rows.get(b, 0) + n
            return table
        counted = self.spark.read.schema(f"{KEY} string, bucket string").parquet(f"{self.root}/{folder}").groupBy("bucket").count().collect()
        for r in counted:
            table.rows[r.bucket] = table.rows.get(r.bucket, 0) + r["count"]
        return table

    def _rewritten(self, table: Table, buckets: set[str], stale: set[str], crowded: set[str], met: DataFrame, folder: str, less: dict[str, int]) -> Table:
        """Stale folders without the keys of `met`, and crowded buckets as one folder. All buckets are one read and one join, so the plan does not grow with them."""
        old, fresh = {}, {}
        for b in sorted(buckets | crowded):
            old[b] = [f for f in table.folders[b] if not f.startswith(f"{folder}/") and (f in stale or b in crowded)]
            fresh[b] = [f for f in table.folders[b] if f.startswith(f"{folder}/") and b in crowded]
            table.folders[b] = [f for f in table.folders[b] if f not in old[b] and f not in fresh[b]]
            table.rows[b] = table.rows.get(b, 0) - less.get(b, 0)
        rows, parts = lambda folders: self.read(Table(table.schema, folders=folders)).withColumn("bucket", self._bucket(table)), []
        if any(old.values()):
            parts.append(rows(old).join(met.select(KEY, "bucket"), [KEY, "bucket"], "left_anti"))
        if any(fresh.values()):
            parts.append(rows(fresh))
        for b, f in self._write(reduce(DataFrame.unionByName, parts), f"{folder}-again")[0].items():
            table.folders[b].append(f)
        table.folders = {b: f for b, f in table.folders.items() if f}
        return table

    def _split_up(self, table: Table, folder: str) -> Table:
        """The table with one more digit for each bucket if its buckets have become too full on average."""
        if not table.rows or sum(table.rows.values()) <= 4 * FULL * len(table.rows):
            return table
        wider = Table(table.schema, table.digits + 1, table.date)
        return self._added(wider, self.read(table).withColumn("bucket", self._bucket(wider)), folder)

    def expire(self, keep: int = 10, older: float = 86_400.0) -> int:
        """Removes all versions but the last `keep`, and folders that none of these names and that are `older` (seconds) than now: loads under way may still name them. How many folders went."""
        for n in self.numbers()[:-keep]:
            self._fs.delete(self._path(f"manifests/{n:012}.json"), False)
        named = {f for n in self.numbers() for v in [self.version(n)] for t in [*v.tables.values(), *v.open.values()] for folders in t.folders.values() for f in folders}
        went, now = 0, time.time()
        old = lambda f: now - self._fs.getFileStatus(self._path(f)).getModificationTime() / 1000 >= older
        for top in ("data", "staging"):
            for made in [f"{top}/{n}/{m}" for n in self._names(top) for m in self._names(f"{top}/{n}")]:
                unused = [f"{made}/{b}" for b in self._names(made) if b.startswith("bucket=") and f"{made}/{b}" not in named]
                for f in filter(old, unused):
                    self._fs.delete(self._path(f), True)
                    went += 1
                if not any(n.startswith("bucket=") for n in self._names(made)) and old(made):
                    self._fs.delete(self._path(made), True)
        return went
