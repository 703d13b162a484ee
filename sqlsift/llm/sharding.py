"""Sharding by sampled splitters: near-equal bytes in key order.

A record's key is 40 bits of its text's hash and 24 bits of its row's hash, so equal texts lie together
and a text that fills a third of the table can still be divided. A size-weighted sample of keys gives
quantile boundaries of ranges; ranges that turn out overfull are sampled again and subdivided. Exact
byte and row totals of the ranges then place every record: its shard is the share of all bytes before its middle.
Equal texts lie in one shard, unless they fill more than an eighth of one: their middle decides for all of them.
Texts are read once; only (id, size, checksum, key) is shuffled, and the driver sees ranges (`most_ranges`) and a sample
of 64 keys a range, not records.

Defined results: a null text has size 16 and checksum 0 (as the empty one, whose group it joins); null ids and repeated
rows are records like others; an empty table gives an empty result; other columns stay, whatever their names. Law: `bytes`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sqlsift.llm.common import schema_with, stored, table, without

_GROUP = 24


def _sample(records: DataFrame, total: int, wanted: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys drawn with a chance in proportion to size, and the bytes each stands for."""
    step = max(1.0, total / wanted)
    chance = F.pmod(F.xxhash64("key", "row", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rows = records.filter(chance < F.col("size") / F.lit(step)).select("key", F.greatest(F.col("size").cast("double"), F.lit(step)).alias("bytes")).toPandas()
    order = np.argsort(rows["key"].to_numpy(), kind="stable")
    return rows["key"].to_numpy(np.int64)[order], rows["bytes"].to_numpy(float)[order]


def _quantiles(keys: np.ndarray, weights: np.ndarray, parts: int) -> np.ndarray:
    if parts < 2 or not len(keys):
        return np.zeros(0, np.int64)
    at = np.searchsorted(np.cumsum(weights), weights.sum() * np.arange(1, parts) / parts)
    return np.unique(keys[np.minimum(at, len(keys) - 1)])


def _ranged(records: DataFrame, splitters: np.ndarray) -> DataFrame:
    cut = records.sparkSession.sparkContext.broadcast(splitters)

    def run(batches):
        for batch in batches:
            keys = batch.column(batch.schema.get_field_index("key")).to_numpy()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.searchsorted(cut.value, keys, "right"), pa.int32())], names=[*batch.schema.names, "range"])

    return records.mapInArrow(run, schema_with(records, range=T.IntegerType()))


def _borders(splitters: np.ndarray) -> np.ndarray:
    """The first keys of the splitters' groups."""
    return np.unique(splitters & np.int64(-(1 << _GROUP)))


def shard(docs: DataFrame, shards: int = 40, text_col: str = "text", ranges_each: int = 8, rows_each: int = 1_000_000, most_ranges: int = 1 << 14) -> DataFrame:
    """Columns of `docs` but its text, with size, text_crc32, law, shard, slot and grown_shard."""
    made = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
    docs = without(docs, *made)
    low = [c.lower() for c in docs.columns]
    text_at = docs.columns.index(text_col) if text_col in docs.columns else low.index(text_col.lower())
    outer = [c for k, c in enumerate(docs.columns) if k != text_at]
    numbered = docs.toDF(*["text" if k == text_at else f"__{k}" for k in range(len(low))]).withColumn("row", F.monotonically_increasing_id())
    rest = [c for c in numbered.columns if c.startswith("__")]
    text = F.coalesce(F.col("text"), F.lit(""))
    records = stored(
        numbered.select(
            *rest, "row", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
            F.xxhash64(text).bitwiseAND(F.lit(-(1 << _GROUP))).bitwiseOR(F.xxhash64(*rest, "row").bitwiseAND(F.lit((1 << _GROUP) - 1))).alias("key"),
        ),
        "shard-records",
    )
    total, count = records.agg(F.sum("size"), F.count("*")).first()
    total = total or 0
    ranges = max(shards * ranges_each, min(most_ranges, -(-count // rows_each)))
    splitters = _borders(_quantiles(*_sample(records, total, 64 * ranges, 0), ranges))
    for attempt in range(1, 6):
        ranged = _ranged(records, splitters)
        sums = sorted((r.range, r.bytes, r.rows) for r in ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect())
        overfull = [(k, b) for k, b, n in sums if b > 2 * total / ranges and n > 1]
        if not overfull:
            break
        inside = ranged.filter(F.col("range").isin([k for k, _ in overfull]))
        keys, weights = _sample(inside, sum(b for _, b in overfull), 256 * len(overfull), attempt)
        grown = splitters
        for k, b in overfull:
            at = np.flatnonzero(np.searchsorted(splitters, keys, "right") == k)
            more = _quantiles(keys[at], weights[at], -(-int(2 * b) // max(1, total // ranges)))
            whole = np.setdiff1d(_borders(more), splitters)
            grown = np.union1d(grown, whole if len(whole) else more)  # within a group only where it fills a range
        if len(grown) == len(splitters):
            break
        splitters = grown
    before, bytes_before, rows_before = [], 0, 0
    for k, b, n in sums:
        before.append((k, bytes_before, rows_before))
        bytes_before, rows_before = bytes_before + b, rows_before + n
    offsets = records.sparkSession.createDataFrame(before, "range int, bytes_before long, rows_before long")
    order = Window.partitionBy("range").orderBy("group", "key", "row")
    same = Window.partitionBy("range", "group")
    placed = ranged.withColumn("group", F.shiftright("key", _GROUP)).select("*", (F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("ahead"), (F.row_number().over(order) - 1).alias("nth"))
    placed = placed.withColumn("together", F.sum("size").over(same)).withColumn("first", F.min("ahead").over(same))
    cut = np.unique(splitters[(splitters & np.int64((1 << _GROUP) - 1)) != 0] >> _GROUP)  # groups of several ranges
    small = (F.col("together") * (8 * shards) <= total) & ~F.col("group").isin(cut.tolist())
    middle = F.when(small, 2 * F.col("first") + F.col("together")).otherwise(2 * F.col("ahead") + F.col("size"))
    placed = placed.withColumn("middle", middle).join(F.broadcast(offsets), "range").select(
        *rest, "size", "text_crc32", (F.col("rows_before") + F.col("nth")).alias("rank"),
        F.least(F.lit(shards - 1), F.expr(f"(2 * bytes_before + middle) * {shards} div {max(1, 2 * total)}")).cast("int").alias("shard"),
    )
    placed = stored(placed, "shard-places")
    first = {r.shard: r.first for r in placed.groupBy("shard").agg(F.min("rank").alias("first")).collect()}
    starts = F.array(*[F.lit(first.get(s, 0)).cast("long") for s in range(shards)])
    out = placed.select(*rest, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("rank") - F.element_at(starts, F.col("shard") + 1)).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    return out.toDF(*outer, *made)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents").select("doc_id", "text"))
