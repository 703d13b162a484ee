"""Exact top-k search by inner product over a pivot-distance index.

A further coordinate gives all vectors one norm, so the largest inner product is the smallest distance.
Pivots and ring bounds come from a bounded sample (`sample_rows`); every row is then indexed under its
nearest pivot and the ring of its distance, rings of about `block_rows` rows; a ring that still holds more
(equal vectors) is dealt into blocks by id. Of every ring the least and largest distance to each pivot are
kept, measured over all its rows: the sorted annuli that hold it. A query's k-th score in the block it lies in
bounds its radius at first. Then it searches rings in the order of the most they can hold by the triangle
inequality, `FIRST` rings in the first round and `FIRST` times as many in each further one; after each the k-th score
found so far tightens the radius, and a query stops when no ring left can hold a row as good. So the result is
exact, and rounds grow with the logarithm of the number of rings; a round in which queries asked for at least half of what it offered is
followed by one of all the rest. Runs of `TOGETHER` blocks and batches of queries that lie near each
other meet by key: a query's vector is written once for each run it asks, with the rings of it that it asks. Groups are bounded on both sides, and a block
travels only to the batches that ask for it. Vectors are kept in the narrowest integers that hold their components.

Defined results: rows with a null id or a vector that is null or holds null or non-finite components take
no part; shorter vectors count as padded with zeros; fewer rows than k give all; ties go to the smaller id. A scaled
component beyond sqrt(2^62 / dimensions) counts as that bound, so that a score always fits a long (with 64 dimensions:
beyond 268,435,456, a component of about a million). An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sqlsift.llm.common import mix, named, stored, table


def _matrix(lists: pa.Array, dims: int) -> np.ndarray:
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lists), dims), np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(lists)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


class PivotIndex:
    """Pivots, the rings of each, and how many blocks a ring is dealt into."""

    def __init__(self, sample: np.ndarray, rows: int, norm: int, exact: bool, pivots: int, block_rows: int, most_rings: int):
        self.norm, self.exact, self.dims = float(norm), exact, sample.shape[1]
        self.kind = np.dtype(next((t for t in (np.int16, np.int32) if norm <= np.iinfo(t).max ** 2), np.int64))
        distinct = np.unique(sample, axis=0)
        at = np.random.default_rng(0).permutation(len(distinct))[:pivots]
        self.pivots = self._lifted(distinct[at])
        of, distance = self.nearest(sample)
        self.bounds: list[np.ndarray] = []
        self.first, self.blocks = [], []
        share = min(rows / max(1, len(sample)), rows)
        each = max(block_rows, rows / most_rings)
        for p in range(len(self.pivots)):
            d = np.sort(distance[of == p])
            rings = max(1, round(len(d) * share / each))
            inner = np.unique(np.quantile(d, np.arange(1, rings) / rings)) if rings > 1 else np.zeros(0)
            self.first.append(len(self.blocks))
            self.bounds.append(inner)
            held = np.bincount(np.searchsorted(inner, d, "right"), minlength=len(inner) + 1) * share
            self.blocks += [max(1, -(-int(h) // (2 * block_rows))) for h in held]
        self.before = np.cumsum(self.blocks) - self.blocks

    def _lifted(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(float)
        return np.c_[x, np.sqrt(np.maximum(0, self.norm - (x * x).sum(axis=1)))]

    def _distances(self, lifted: np.ndarray) -> np.ndarray:
        d = (lifted**2).sum(axis=1)[:, None] + (self.pivots**2).sum(axis=1) - 2 * lifted @ self.pivots.T
        return np.sqrt(np.maximum(0, d))

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = self._distances(self._lifted(x))
        of = d.argmin(axis=1)
        return of, d[np.arange(len(x)), of]

    def place(self, x: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ring and block of each row."""
        of, d = self.nearest(x)
        ring = np.empty(len(x), np.int64)
        for p in np.unique(of):
            ring[of == p] = self.first[p] + np.searchsorted(self.bounds[p], d[of == p], "right")
        return ring, (mix(ids.astype(np.uint64)) % np.array(self.blocks, np.uint64)[ring]).astype(np.int64)

    def annuli(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and largest distance of rows to each pivot."""
        d = self._distances(self._lifted(x))
        return d.min(axis=0), d.max(axis=0)

    def most(self, q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Queries x rings: the highest score a ring can hold, by its distances (rings x pivots). Distances near zero are off by 1e-7 of a norm."""
        x = q.astype(float)
        own = (x * x).sum(axis=1)
        d = self._distances(np.c_[x, np.zeros(len(x))])
        gap = np.zeros((len(x), len(low)))
        for p in range(d.shape[1]):
            np.maximum(gap, np.maximum(low[:, p] - d[:, p : p + 1], d[:, p : p + 1] - high[:, p]), out=gap)
        return (own[:, None] + self.norm - gap**2) / 2 + 1e-6 * (own[:, None] + self.norm) + 1e-6

    def scores(self, q: np.ndarray, rows: np.ndarray) -> np.ndarray:
        if self.exact:
            return np.rint(q.astype(float) @ rows.astype(float).T).astype(np.int64)
        return q.astype(np.int64) @ rows.astype(np.int64).T


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best of one query, ties to the smaller id."""
    if len(ids) > 4 * k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= cut)
    else:
        at = np.arange(len(ids))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


_NEVER = np.iinfo(np.int64).min
#: Rings that a query searches in its first round, and the growth of rounds.
FIRST = 8
#: Blocks, one after the other in the index, that meet queries together.
TOGETHER = 16


def exact_top_k(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5, scale: int = 256, most_pivots: int = 128, sample_rows: int = 8192, block_rows: int = 4096, most_rings: int = 1 << 14, query_rows: int = 1 << 16, progress: Callable[[int, int], None] | None = None) -> DataFrame:
    """For every query row its k best other rows: query_id, rank, vec_id, score.

    `most_pivots` x (`most_rings` + `most_pivots`) x 16 bytes bound what is broadcast; one pivot stands for 64 rows at
    least. After each round `progress` gets the pairs of a query and a ring it searched, and all such pairs.
    """
    spark = vectors.sparkSession
    rows = vectors.select(named(vectors, id_col).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("query"), named(vectors, vec_col).alias("v"))
    ok = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & ok)
    dims = rows.agg(F.max(F.size("v"))).first()[0] or 0
    most = F.lit(float(math.isqrt((1 << 62) // max(1, dims))))
    rows = stored(rows.select("id", "query", F.transform("v", lambda x: F.floor(F.greatest(-most, F.least(most, x.cast("double") * scale)))).alias("v")), "vectors")
    square = F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x * x)
    n, nq, norm = rows.agg(F.count("*"), F.count_if("query"), F.max(square)).first()
    result = "query_id long, rank int, vec_id long, score long"
    if not n:
        return spark.createDataFrame([], result)
    dims = max(1, dims)
    chance = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rows.filter(chance < F.lit(sample_rows / n)).select("v").limit(4 * sample_rows).toArrow()
    if not len(sample):
        sample = rows.select("v").limit(sample_rows).toArrow()
    index = PivotIndex(_matrix(sample["v"], dims), n, norm, norm * 4 < 1 << 52, min(most_pivots, max(1, n // 64)), block_rows, most_rings)
    shared = spark.sparkContext.broadcast(index)
    parts = max(1, -(-nq // query_rows))

    def key(batches):
        for b in batches:
            x, ids = _matrix(b.column(2), dims), b.column(0).to_numpy()
            ring, block = shared.value.place(x, ids)
            yield pa.RecordBatch.from_arrays([pa.array(ring, pa.int32()), pa.array(block, pa.int32()), *b.columns], names=["ring", "block", "id", "query", "v"])

    def gather(t: pa.Table) -> pa.Table:
        x, ids = _matrix(t["v"], dims), t["id"].to_numpy()
        kept, run = x.astype(shared.value.kind), int(shared.value.before[t["ring"][0].as_py()] + t["block"][0].as_py()) // TOGETHER
        mine = np.flatnonzero(t["query"].to_numpy())
        low, high = shared.value.annuli(x)
        out = [("rows", ids.tobytes(), kept.tobytes(), None, None, low, high)]
        for lo in range(0, len(mine), 256):
            some = mine[lo : lo + 256]
            scores = shared.value.scores(x[some], x)
            scores[ids[some][:, None] == ids] = _NEVER
            least = np.partition(scores, -k, axis=1)[:, -k] if len(ids) > k else np.full(len(some), _NEVER)
            out += [("query", ids[q : q + 1].tobytes(), kept[q].tobytes(), int(v), int(ids[q]), None, None) for q, v in zip(some, least)]
        cols = list(zip(*out))
        same = [pa.array([int(t[c][0].as_py())] * len(out), pa.int32()) for c in ("ring", "block")]
        kinds = (pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()))
        return pa.table([*same, pa.array([run] * len(out), pa.int32()), *(pa.array(c, kind) for c, kind in zip(cols, kinds))], names=["ring", "block", "run", "kind", "ids", "v", "least", "id", "low", "high"])

    built = rows.mapInArrow(key, "ring int, block int, id long, query boolean, v array<bigint>").groupBy("ring", "block").applyInArrow(gather, "ring int, block int, run int, kind string, ids binary, v binary, least long, id long, low array<double>, high array<double>")
    built = stored(built, "pivot-index")
    blocks = built.filter("kind = 'rows'").select("run", "ring", "ids", "v")
    # one row a ring, whatever its number of blocks
    ends = built.filter("kind = 'rows'").select("ring", F.posexplode(F.arrays_zip("low", "high")).alias("pivot", "x")).groupBy("ring", "pivot").agg(F.min("x.low").alias("low"), F.max("x.high").alias("high"))
    ends = ends.groupBy("ring").agg(F.array_sort(F.collect_list(F.struct("pivot", "low", "high"))).alias("x")).select("ring", "x.low", "x.high").toArrow()
    rings = len(index.blocks)
    low, high = (np.full((rings, len(index.pivots)), end) for end in (np.inf, -np.inf))
    at = ends["ring"].to_numpy()
    for name, into in (("low", low), ("high", high)):
        into[at] = ends[name].combine_chunks().flatten().to_numpy().reshape(len(at), -1)
    annuli = spark.sparkContext.broadcast((low, high))
    slice_rows = max(1, min(256, (1 << 20) // rings))

    def probe_round(first: int, end: int):
        """For rows ring, block (their own), ids, v, least of queries: the rings they search from place `first` to `end` of their order."""

        def probe(batches):
            index, total = shared.value, sum(shared.value.blocks)
            start, stop = index.before // TOGETHER, (index.before + np.array(index.blocks) - 1) // TOGETHER
            for b in batches:
                for lo in range(0, b.num_rows, slice_rows):
                    s = b.slice(lo, slice_rows)
                    part = (index.before[s.column(0).to_numpy()] + s.column(1).to_numpy()) * parts // total
                    ids = np.frombuffer(b"".join(s.column(2).to_pylist()), np.int64)
                    q = np.frombuffer(b"".join(s.column(3).to_pylist()), index.kind).reshape(-1, dims)
                    least = s.column(4).to_numpy()
                    most = index.most(q, *annuli.value)
                    meet = np.zeros(most.shape, bool)
                    np.put_along_axis(meet, np.argsort(-most, axis=1, kind="stable")[:, first:end], True, axis=1)
                    meet &= most >= least[:, None].astype(float)
                    out = []
                    for p in np.unique(part):
                        mine = meet & (part == p)[:, None]
                        asked = np.flatnonzero(mine.any(axis=0))
                        runs = np.concatenate([np.stack([np.arange(start[r], stop[r] + 1), np.full(stop[r] - start[r] + 1, r)], 1) for r in asked.tolist()]) if len(asked) else np.zeros((0, 2), np.int64)
                        for run in np.unique(runs[:, 0]).tolist():
                            rings = runs[runs[:, 0] == run, 1]
                            some = mine[:, rings].any(axis=1)
                            which = mine[some][:, rings]
                            # a ring is counted where it begins
                            counts = np.where(start[rings] == run, which.sum(axis=0), 0)
                            out.append((run, int(p), ids[some].tobytes(), q[some].tobytes(), least[some].tobytes(), rings.tolist(), counts.tolist(), np.packbits(which, axis=None).tobytes()))
                    if out:
                        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.binary()]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["run", "part", "ids", "v", "least", "rings", "counts", "which"])

        return probe

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple] = []
        kind = shared.value.kind
        if len(right):
            held = [(ring.as_py(), np.frombuffer(ids.as_py(), np.int64), np.frombuffer(v.as_py(), kind).reshape(-1, dims)) for ring, ids, v in zip(left["ring"], left["ids"], left["v"])]
            for row in right.select(["ids", "v", "least", "rings", "which"]).to_pylist():
                qs, least = (np.frombuffer(row[c], np.int64) for c in ("ids", "least"))
                qv = np.frombuffer(row["v"], kind).reshape(-1, dims)
                which = np.unpackbits(np.frombuffer(row["which"], np.uint8), count=len(qs) * len(row["rings"])).reshape(len(qs), -1).astype(bool)
                for ring, ids, x in held:
                    if ring not in row["rings"]:
                        continue
                    some = np.flatnonzero(which[:, row["rings"].index(ring)])
                    for q, s, low in zip(qs[some], shared.value.scores(qv[some], x), least[some]):
                        at = np.flatnonzero((s >= low) & (ids != q))
                        found += [(q, ids[a], s[a]) for a in at[_best(s[at], ids[at], k)]]
        cols = np.array(found, np.int64).reshape(-1, 3)
        return pa.table({"query_id": cols[:, 0], "vec_id": cols[:, 1], "score": cols[:, 2]})

    by = ("run", "part")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    queries = built.filter("kind = 'query'").select("ring", "block", "ids", "v", "least", "id")
    found = spark.createDataFrame([], result)
    first, end = 0, FIRST
    while first < rings:
        kth = found.filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("kth"))
        asking = (queries.join(kth, "id", "left").withColumn("least", F.greatest("least", "kth")) if first else queries).select("ring", "block", "ids", "v", "least")
        probes = stored(asking.mapInArrow(probe_round(first, end), "run int, part int, ids binary, v binary, least binary, rings array<int>, counts array<long>, which binary"), "probes")
        asked = probes.select("part", F.explode(F.arrays_zip("rings", "counts")).alias("x")).groupBy(F.col("x.rings").alias("ring"), "part").agg(F.sum("x.counts").alias("n"))
        pairs, ways = asked.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
        if progress:
            progress(pairs, nq * rings)
        if not pairs:
            break
        asked = asked.select("ring", F.col("part").alias("part"))
        met = blocks.join(F.broadcast(asked) if ways <= 1 << 20 else asked, "ring")
        hits = met.groupBy(*by).cogroup(probes.groupBy(*by)).applyInArrow(search, "query_id long, vec_id long, score long")
        hits = hits.unionByName(found.select("query_id", "vec_id", "score"))
        ranked = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        found = stored(ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"), "best")
        first, end = end, rings if 2 * pairs >= nq * (min(end, rings) - first) else end * FIRST
    return found


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)


OP6_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, cast(rank AS INT) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
