"""Log entries as they arrive: statements paired with durations that come later, and batches taken into the stored star schema.

A statement without a duration is kept until the client's next such entry, whether that comes in the same batch, a later one or after a restart, and let go
if it waits too long: by `into_store` as a row of the store, by `paired`, for other sinks, as state of the query. There clients share states by groups of their hash
(`GROUPS`), as a state costs calls between processes. Each batch is committed to the store with its number and the statements that wait, so one that is run again after a failure changes nothing.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from sqlsift.plans import load
from sqlsift.sources import logs
from sqlsift.sources.ranges import LogSource

_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def watch(spark: SparkSession, path: str, settle_seconds: float = 60, range_bytes: int = 64 << 20) -> DataFrame:
    """file, entry_no, entry of log files under a path, as they grow and appear; see `ranges`."""
    spark.dataSource.register(LogSource)
    return spark.readStream.format(LogSource.name()).option("settleSeconds", settle_seconds).option("rangeBytes", range_bytes).load(path)


#: Groups of clients that share a state; part of a checkpoint's layout.
GROUPS = 4096


class _Pairing(StatefulProcessor):
    """The open statements of a group of clients: state is read and written once a group and batch, not once a client."""

    def __init__(self, schema: T.StructType, client: list[str], wait_ms: int):
        self.schema, self.client, self.wait = schema, client, wait_ms
        self.names = schema.fieldNames()

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", T.StructType([T.StructField("until", T.LongType()), *self.schema.fields]))

    def _keep(self, held: dict[tuple, tuple]) -> None:
        """Writes the open statements; the timer is that of the first to go, earlier ones that are left find nothing to do."""
        if held:
            self.open.put(list(held.values()))
            self.handle.registerTimer(min(x[0] for x in held.values()))
        else:
            self.open.clear()

    def _held(self) -> dict[tuple, tuple]:
        places = [1 + self.names.index(c) for c in self.client]
        return {tuple(x[p] for p in places): tuple(x) for x in self.open.get()} if self.open.exists() else {}

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self._held()
        until = int(time.time() * 1000) + self.wait
        places = [self.names.index(n) for n in ("entry_no", "duration_lit", "duration_measure")]
        for row in sorted(rows, key=lambda r: (r["file"], r["entry_no"])):
            who = tuple(row[c] for c in self.client)
            if row["query"]:
                held[who] = (until, *[row[n] for n in self.names])
            elif (kept := held.pop(who, None)) is not None:
                pair = list(kept[1:])
                for p in places:
                    pair[p] = row[self.names[p]]
                yield Row(**dict(zip(self.names, pair)))
        self._keep(held)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        held = self._held()
        left = {who: x for who, x in held.items() if x[0] > now}
        if len(left) < len(held):
            self._keep(left)
        return iter(())

    def close(self) -> None:
        pass


def paired(rows: DataFrame, by_file: bool = True, wait_hours: float = 24) -> DataFrame:
    """As `logs.paired` on parsed entries that arrive; entries that need no partner pass at once and are not shuffled.

    `by_file`: a client is one within a file, as in batches; else a duration may come in a later file than its statement (of one
    client and process). Of a batch, entries are taken in the order of files and places. A statement that no duration follows within `wait_hours` is let go. Sets the
    session's state store to RocksDB, which timers need.
    """
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    hold = (F.col("severity") == "LOG") & (F.col("duration_lit") == "") & (F.col("query") != "")
    alone = (F.col("query") == "") & (F.col("duration_lit") != "")
    waits = F.coalesce(F.col("fits") & (hold | alone), F.lit(False))
    client = [*(["file"] if by_file else ["pid"]), "remote_host", "user", "database", "severity"]
    grouped = rows.filter(waits).withColumn("client_group", F.pmod(F.xxhash64(*client), F.lit(GROUPS)))
    pairs = grouped.groupBy("client_group").transformWithState(_Pairing(rows.schema, client, int(wait_hours * 3_600_000)), rows.schema, "Append", "ProcessingTime")
    return rows.filter(~waits).unionByName(pairs)


def into_store(entries: DataFrame, root: str, checkpoint: str, name: str, source_name: str = "", source_url: str = "", by_file: bool = True, wait_hours: float = 24, **trigger) -> StreamingQuery:
    """Starts a query that takes entries (of `watch`) into the star schema at `root`, a commit for each batch. `name` is the stream's in the store: one for each checkpoint.

    Statements that wait for durations are kept in the store (`load.load_batch`), not as state of the query: they are read, paired and written as tables, and the log is parsed once.
    """

    def take(batch: DataFrame, number: int) -> None:
        load.load_batch(batch.sparkSession, batch, root, name, number, source_name, source_url, by_file, wait_hours)

    return logs.parsed(entries).writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
