"""Log files into a stored star schema: gate, parse, share by share, merge, commit.

What is read is staged once below `staging`; merges into the tables (see `store`) start from it, so a load that finds another has
committed first merges again without reading again. Files that `processed_files` names are left out. A text that any load parsed
before comes from `texts`. Bad entries and bad texts stay with their input in `quarantined` and `error_texts`. Counts come from the writes.

Totals by hour and user are sums of shares, one for each origin (a file, or a batch of a stream): files that share an hour add up, and
a file that is read again replaces its own share. With `hours="replace"` the totals of a later load take the place of the earlier ones.
"""

from __future__ import annotations

import time
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlsift.functions.ids import uuid5
from sqlsift.operators.upsert import unprocessed
from sqlsift.plans import ingest
from sqlsift.plans.store import Store, Table, Version, observed
from sqlsift.sources import logs
from sqlsift.sources.ranges import listed

#: How a table takes rows whose key it has: the old row stays, or the new one wins.
STAYS = ("queries", "databases", "sources", "create_statements_in_queries", "table_joins_in_queries", "error_texts", "processed_files", "texts", "quarantined", "owners", "owners_tables")
WINS = ("queries_by_hours", "query_users", "tables", "tables_in_queries", "columns_in_queries", "functions_in_queries", "create_statements", "hour_shares", "user_shares")
#: Tables whose buckets are dates.
DATED = {"queries_by_hours": "queried_date", "query_users": "queried_date", "hour_shares": "queried_date", "user_shares": "queried_date"}
_SUMS = {"hour_shares": ("total_count", "total_duration_us", "total_queries_in_transaction"), "user_shares": ("total_count", "total_duration_us")}
_TOTALS = {"hour_shares": "queries_by_hours", "user_shares": "query_users"}


def version(spark: SparkSession, root: str) -> int:
    """The last version, 0 if there is none."""
    return max(Store(spark, root).numbers(), default=0)


def tables(spark: SparkSession, root: str, at: int | None = None) -> dict[str, DataFrame]:
    """The tables of a version, the last by default; none before the first load."""
    store = Store(spark, root)
    return {name: store.read(t) for name, t in store.version(at).tables.items()}


class _Load:
    """One load: staged rows, and merges of them into a version."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store, self.id = spark, Store(spark, root), uuid.uuid4().hex
        self.counts: dict[str, int] = {}
        self.sizes: dict[str, int] = {}

    def staged(self, df: DataFrame, name: str, count: str | None = None) -> DataFrame:
        """`df` written and read back; its rows are counted as they are written."""
        path = f"{self.store.root}/staging/{self.id}/{name}-{uuid.uuid4().hex[:8]}"
        self.sizes[name], _ = observed(df, path)
        if count:
            self.counts[count] = self.sizes[name]
        return self.spark.read.schema(df.schema).parquet(path)

    def commit(self, base: Version, found: dict[str, DataFrame], batch: tuple[str, int] | None, replaced: DataFrame | None = None, again=None, waiting: Table | None = None) -> Version | None:
        """The version with `found`; None if what another load committed meanwhile makes this one void (`again` says so)."""
        for attempt in range(100):
            made = self.merged(base, found, replaced, f"{self.id}-{attempt}")
            if self.store.commit(base, made, self.counts, batch, waiting):
                self.store._fs.delete(self.store._path(f"staging/{self.id}"), True)
                return self.store.version(base.number + 1)
            base = self.store.version()
            if again is not None and again(base):
                return None
        raise RuntimeError("other loads were first a hundred times")

    def merged(self, base: Version, found: dict[str, DataFrame], replaced: DataFrame | None, load: str) -> dict[str, Table]:
        """The changed tables. `replaced`: origins whose shares go before the new ones come."""

        def one(name: str) -> list[tuple[str, Table]]:
            old, folder = base.tables.get(name), f"data/{name}/{load}"
            gone = None
            if name in _SUMS and replaced is not None and old is not None:
                gone = self.staged(self.store.read(old).join(replaced, "origin", "left_semi"), f"{name}-gone")
            if old is not None and not self.sizes[name] and (gone is None or not self.sizes[f"{name}-gone"]):
                return []
            out = [(name, self.store.merge(old, found[name], name in WINS, folder, DATED.get(name), gone, self.sizes[name]))]
            if name in _SUMS:
                total = _TOTALS[name]
                new, lost = self.totals(name, out[0][1], found[name], gone)
                out.append((total, self.store.merge(base.tables.get(total), new, True, f"data/{total}/{load}", DATED[total], lost, self.sizes[f"{name}-totals"])))
            return out

        with ThreadPoolExecutor(8) as pool:
            return dict(x for xs in pool.map(one, found) for x in xs)

    def totals(self, name: str, shares: Table, new: DataFrame, gone: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
        """Totals of every hour that new or gone shares are of, and the hours that have no share left."""
        hours = new.select("total_uid", "queried_date")
        hours = self.staged((hours if gone is None else hours.unionByName(gone.select("total_uid", "queried_date"))).distinct(), f"{name}-hours")
        dates = {str(r.queried_date) for r in hours.select("queried_date").distinct().collect()}
        rows = self.store.read(shares, {b for b in shares.folders if b.split(".")[0] in dates}).join(hours.select("total_uid"), "total_uid", "left_semi")
        same = [c for c in rows.columns if c not in ("uid", "origin", "total_uid", *_SUMS[name])]
        sums = rows.groupBy(F.col("total_uid").alias("uid")).agg(*[F.first(c).alias(c) for c in same], *[F.sum(c).alias(c) for c in _SUMS[name]])
        sums = self.staged(sums, f"{name}-totals")
        return sums, None if gone is None else hours.withColumnRenamed("total_uid", "uid").join(sums.select("uid"), "uid", "left_anti")


def _found(load: _Load, base: Version, runs: DataFrame, bad: DataFrame, source_name: str, source_url: str, origin, hours: str) -> dict[str, DataFrame]:
    """The staged rows of every table from executions and quarantined entries."""
    spark, store = load.spark, load.store
    said = load.staged(runs.select("query").distinct().withColumn("uid", uuid5(F.col("query"))), "said", "texts")
    known = store.matched(base.tables.get("texts"), said)
    known = load.staged(known, "known") if known is not None else None
    parsed = load.staged(ingest.analyzed(said, known), "texts", "parsed")
    texts = parsed if known is None else parsed.unionByName(known.select(parsed.columns))
    found = ingest.star(runs, texts, load.staged)
    source = uuid5(F.lit(source_name))
    found["queries"] = found["queries"].withColumn("source_uid", source)
    found["sources"] = spark.range(1).select(source.alias("uid"), F.lit(source_name).alias("name"), F.lit(source_url).alias("url"))
    found["texts"] = parsed.select(uuid5(F.col("query")).alias("uid"), "query", "error", "statements")
    found["error_texts"] = texts.filter("error is not null").select(uuid5(F.col("query")).alias("uid"), "query", "error")
    found["quarantined"] = bad.select(uuid5(F.concat_ws("|", "file", "entry_no")).alias("uid"), "file", "entry_no", "entry")
    found["functions_in_queries"] = found["functions_in_queries"].distinct().withColumn("uid", uuid5(F.concat_ws("|", "query_uid", "function_name")))
    found["query_users"] = found["query_users"].join(found["queries_by_hours"].select(F.col("uid").alias("queries_by_hour_uid"), "queried_date"), "queries_by_hour_uid").select("uid", "queries_by_hour_uid", "user_name", "total_count", "total_duration_us", "legacy_uid", "queried_date")
    if hours == "add":
        said = ingest.statements(runs.withColumn("origin", origin), texts)
        shares = ingest.shares(load.staged(said.select("query_uid", "hour", "user_name", "origin", "tx_count", "duration_us"), "statements"))
        found |= {name: rows.select(uuid5(F.concat_ws("|", "origin", "uid")).alias("uid"), "origin", F.col("uid").alias("total_uid"), *[c for c in rows.columns if c not in ("uid", "origin")]) for name, rows in shares.items()}
        del found["queries_by_hours"], found["query_users"]
    del found["errors"]
    with ThreadPoolExecutor(8) as pool:
        rows = dict(zip(found, pool.map(lambda k: load.staged(found[k], k, "errors" if k == "error_texts" else "quarantined" if k == "quarantined" else None), found)))
    return rows


def load(spark: SparkSession, files: DataFrame, root: str, source_name: str = "", source_url: str = "", hours: str = "add", reread: bool = False) -> dict[str, int]:
    """Takes the files (of `logs.read_logs`, or file and text) that no load before took into the star schema at `root`; returns counts of what it met.

    `reread`: takes all of `files`, also those taken before; their shares of hours and users are replaced (not with `hours="replace"`).
    """
    if hours not in ("add", "replace"):
        raise ValueError("hours is add or replace")
    while True:
        this = _Load(spark, root)
        base = this.store.version()
        done = base.tables.get("processed_files")
        todo = files if done is None or reread else unprocessed(files, this.store.read(done))
        rows = this.staged(logs.parsed(todo), "entries", "met")
        names = this.staged(rows.select(F.col("file").alias("file_name")).distinct(), "names", "files")
        runs = this.staged(logs.executions(logs.paired(logs.entries(rows))), "runs", "executions")
        found = _found(this, base, runs, logs.quarantined(rows), source_name, source_url, F.col("file"), hours)
        found["processed_files"] = this.staged(names.select(uuid5(F.col("file_name")).alias("uid"), "file_name", F.current_timestamp().cast("timestamp_ntz").alias("processed_at")), "processed_files")

        def void(now: Version) -> bool:
            """Whether a file of this load was taken meanwhile."""
            others = this.store.matched(now.tables.get("processed_files"), found["processed_files"].select("uid"))
            before = this.store.matched(done, found["processed_files"].select("uid"))
            return others is not None and others.count() > (before.count() if before is not None else 0)

        replaced = names.select(F.col("file_name").alias("origin")) if reread and hours == "add" else None
        if this.commit(base, found, None, replaced, void):
            this.counts["entries"] = this.counts.pop("met")
            return this.counts


def load_path(spark: SparkSession, path: str, root: str, source_name: str = "", source_url: str = "", hours: str = "add", range_bytes: int = 64 << 20) -> dict[str, int]:
    """As `load` of the log files under a path; files taken before are not opened."""
    store = Store(spark, root)
    names = [name for name, _, _ in listed(path)]
    done = store.version().tables.get("processed_files")
    if done is not None and names:
        taken = store.matched(done, spark.createDataFrame([(n,) for n in names], "file_name string").withColumn("uid", uuid5(F.col("file_name"))))
        gone = {r.file_name for r in taken.select("file_name").toLocalIterator()} if taken is not None else set()
        names = [n for n in names if n not in gone]
    return load(spark, logs.read_logs(spark, path, range_bytes, names), root, source_name, source_url, hours)


def _paired(load: _Load, rows: DataFrame, waiting: Table | None, by_file: bool, wait_hours: float) -> tuple[DataFrame, Table]:
    """The parsed entries of a batch, holds with their durations, and the holds that no duration followed yet: these of the batch and of `waiting`, what the batches before left."""
    store, folder, now = load.store, f"data/open/{load.id}", int(time.time() * 1000)
    path, columns = f"{store.root}/staging/{load.id}/arrived", rows.columns
    rows = rows.withColumn("kind", logs.kind())
    _, whole = observed(rows, path, same=F.col("kind") == "whole")
    rows = load.spark.read.schema(rows.schema).parquet(path)
    met = rows.withColumn("until", F.lit(now + int(wait_hours * 3_600_000))).withColumn("age", F.lit(1))
    if waiting is not None:
        met = met.unionByName(store.read(waiting).withColumn("kind", F.lit("hold")).withColumn("age", F.lit(0)))
    holds = logs.followed(met, [*(["file"] if by_file else ["pid"]), "remote_host", "user", "database", "severity"], 64 << 20, "age")
    holds = holds.filter(f"next.kind = 'duration' or next is null and (age = 1 or until > {now})").withColumn("bucket", F.when(F.col("next").isNull(), "open").otherwise("paired"))
    holds = logs.with_next(holds, [*columns, "until", "bucket"])
    n, pairs = observed(holds, f"{store.root}/{folder}", "bucket", same=F.col("bucket") == "paired", spread=False)
    load.counts["entries"] = whole + pairs
    made = lambda b, rows: Table(holds.drop("bucket").schema.json(), folders={b: [f"{folder}/bucket={b}"]} if rows else {}, rows={b: rows})
    return rows.filter("kind = 'whole'").drop("kind").unionByName(store.read(made("paired", pairs)).drop("until")), made("open", n - pairs)


def load_batch(spark: SparkSession, rows: DataFrame, root: str, stream: str, batch: int, source_name: str = "", source_url: str = "", by_file: bool = True, wait_hours: float = 24) -> dict[str, int]:
    """Takes a batch of parsed entries of a stream; one that was committed before changes nothing and counts nothing.

    Statements whose durations have not come are kept with the version, and paired in the batch in which these come: so they are as the store's tables are, whatever
    batch is run again. `by_file`: a client is one within a file, else a duration may come in a later file than its statement (of one client and process). Of a batch,
    entries are taken in the order of files and places. A statement that waits for more than `wait_hours` is let go after a batch.
    """
    this = _Load(spark, root)
    base = this.store.version()
    if base.batches.get(stream, -1) >= batch:
        return {}
    rows, waiting = _paired(this, rows, base.open.get(stream), by_file, wait_hours)
    runs = this.staged(logs.executions(logs.entries(rows)), "runs", "executions")
    found = _found(this, base, runs, logs.quarantined(rows), source_name, source_url, F.concat(F.lit(f"{stream}#{batch}#"), "file"), "add")
    committed = this.commit(base, found, (stream, batch), None, lambda now: now.batches.get(stream, -1) >= batch, waiting)
    this.store._fs.delete(this.store._path(f"data/open/{this.id}" + ("/bucket=paired" if committed else "")), True)
    return this.counts if committed else {}


def load_owners(spark: SparkSession, imported: DataFrame, root: str) -> None:
    """Takes owners of tables ({database, data: [{table, owners}]}) into the stored schema; what is there stays."""
    this = _Load(spark, root)
    found = {k: this.staged(v, k) for k, v in ingest.owners(imported, spark.createDataFrame([], "uid string")).items()}
    base = this.store.version()
    known = base.tables.get("tables")
    if known is not None:
        found["tables"] = this.staged(found["tables"].join(this.store.read(known).select("uid"), "uid", "left_anti"), "tables")
    this.commit(base, found, None)


def expire(spark: SparkSession, root: str, keep: int = 10, older: float = 86_400.0) -> int:
    """Removes versions but the last `keep`, and files of `older` seconds that none of these needs."""
    return Store(spark, root).expire(keep, older)
