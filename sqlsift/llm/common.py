"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import inspect
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

ASCII_SPACE = " \t\n\x0b\x0c\r"
#: Upper bound of any single broadcast made here, in bytes.
BROADCAST_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the one the cluster names. A temporary one of our own where none is named and all runs in this process.

    Tables written there stay until whoever owns the folder clears it, as with checkpoints, or `settled` does.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="sqlsift-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Tables written while `settled` makes a result, by call.
_MADE: list[list[str]] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written as a table in the shared folder and read back: what follows neither recomputes nor loses it.

    Within `settled` it goes when the result is written; else it stays until whoever owns the folder clears it.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    if _MADE:
        _MADE[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, *paths: str) -> None:
    """Deletes tables of the shared folder."""
    for path in paths:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def settled(spark: SparkSession, make, name: str) -> tuple[DataFrame, str]:
    """What `make()` gives, written and read back, and where; all tables that were stored to make it are deleted."""
    made: list[str] = []
    _MADE.append(made)
    try:
        out = stored(make(), name)
    finally:
        _MADE.remove(made)
    dropped(spark, *made[:-1])
    return out, made[-1]


def scan_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the size of `df`; it only chooses how many pieces work is cut into."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def pieces(df: DataFrame, each: int, least: int) -> int:
    """How many pieces of `each` bytes `df` makes, `least` at least (an unknown size counts as 1 TB)."""
    size = scan_bytes(df)
    return max(least, -(-min(size, 1 << 40 if size > 1 << 60 else size) // each))


def without(df: DataFrame, *names: str) -> DataFrame:
    """`df` less the columns whose names a result takes (in any letter case)."""
    taken = {n.lower() for n in names}
    return df.select(*[f"`{c.replace('`', '``')}`" for c in df.columns if c.lower() not in taken])


def named(df: DataFrame, name: str):
    """The column of `df` of this name in any letter case, whatever characters the name holds."""
    found = next((c for c in df.columns if c == name), None) or next((c for c in df.columns if c.lower() == name.lower()), name)
    return df[f"`{found.replace('`', '``')}`"]


def mapped(df: DataFrame, columns: dict[str, str], run, **kinds: T.DataType) -> DataFrame:
    """`df` through the Arrow function `run`, which adds `kinds`. It sees `columns` (by its own names: those of `df`) and passes all others on, whatever they are called."""
    outer, low = df.columns, [c.lower() for c in df.columns]
    inner = {(outer.index(name) if name in outer else low.index(name.lower())): own for own, name in columns.items()}
    plain = df.toDF(*[inner.get(k, f"__{k}") for k in range(len(outer))])
    return plain.mapInArrow(run, schema_with(plain, **kinds)).toDF(*outer, *kinds)


def schema_with(df: DataFrame, **kinds: T.DataType) -> T.StructType:
    return T.StructType(list(df.schema.fields) + [T.StructField(k, v) for k, v in kinds.items()])


def column(batch, name: str):
    """The column of a record batch, its name in any letter case."""
    names = [c.lower() for c in batch.schema.names]
    return batch.column(names.index(name.lower()))


def mix(keys: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser over uint64 keys."""
    with np.errstate(over="ignore"):
        x = keys + np.uint64((0x9E3779B97F4A7C15 * (2 * seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sum of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[starts], np.add.reduceat(counts, starts)


#: What a worker keeps from one task to the next, by the operator it is for.
KEPT: dict[str, dict] = {}


def give_back(owner: str = "") -> None:
    """Ends what other operators keep in this worker, and returns freed memory to the system: workers outlive their tasks."""
    import pyarrow as pa

    for other in [k for k in KEPT if k != owner]:
        del KEPT[other]
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(run, owner: str = ""):
    """The Arrow function `run` (over batches or over one group), giving memory back when it ends."""
    if inspect.isgeneratorfunction(run):

        def lean_run(batches):
            try:
                yield from run(batches)
            finally:
                give_back(owner)

    elif len(inspect.signature(run).parameters) == 1:

        def lean_run(group):
            try:
                return run(group)
            finally:
                give_back(owner)

    else:

        def lean_run(left, right):
            try:
                return run(left, right)
            finally:
                give_back(owner)

    return lean_run


def sorted_distinct(keys: np.ndarray) -> np.ndarray:
    """As np.unique, by a plain sort: several times as fast on 64-bit keys."""
    keys = np.sort(keys)
    return keys[np.r_[True, keys[1:] != keys[:-1]]] if len(keys) else keys


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenated ranges start .. start + length."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def chunks(batch, name: str, limit: int = 2 << 20):
    """Slices of a record batch with about `limit` bytes of text each (one row at least)."""
    import pyarrow.compute as pc

    sizes = np.cumsum(pc.fill_null(pc.binary_length(column(batch, name)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16)
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + limit, "right")))
        yield batch.slice(at, end - at)
        at = end
