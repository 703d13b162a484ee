"""Line dedup: a sharded minimal perfect hash over distinct line hashes, probed by the documents.

Pass 1 counts, for every line key, the documents that hold it: each task sends packed (hash, count)
arrays to hash shards, so a common line costs one entry a task. A shard writes a minimal perfect hash over all
its distinct keys, with arrays of 16-bit fingerprints and of counts (one byte each if the threshold fits).
Pass 2 probes these arrays; no line is joined. Every line of the documents is in the index, so a probe always
meets its own entry; the fingerprint is a check on that, and a probe that fails it ends the job.
An index of at most `limit` bytes is broadcast whole. A larger one stays where it is: documents are dealt into
blocks (one more copy of them), a block asks each shard for the counts of its distinct lines in one packed row, and answers come back in the
order asked. Both ways give the same rows.

Defined results: a null or empty text is one empty line and is kept; blank lines are never dropped;
repeated rows count as documents of their own; an empty table gives an empty result; other columns stay,
whatever their names.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sqlsift.llm.common import BROADCAST_BYTES, chunks, column, lean, mapped, mix, named, pieces, sorted_distinct, stored, summed, table, without

_FLUSH = 2_000_000


class PerfectHash:
    """Minimal perfect hash: at each level the keys that are alone in their slot take it, the others go on."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, spread: float = 1.6):
        words, self.levels, left, base = [], [], np.arange(len(keys)), 0
        placed_at, placed = [], []
        while len(left):
            m = -(-int(max(len(left) * spread, 64)) // 64) * 64
            slot = (mix(keys[left], len(self.levels)) % np.uint64(m)).astype(np.int64)
            alone = np.bincount(slot, minlength=m)[slot] == 1
            bits = np.zeros(m, np.uint8)
            bits[slot[alone]] = 1
            words.append(np.packbits(bits, bitorder="little").view(np.uint64))
            self.levels.append((base, m))
            placed_at.append(base + slot[alone])
            placed.append(left[alone])
            left, base = left[~alone], base + m
        self.words = np.concatenate(words) if words else np.zeros(0, np.uint64)
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.rank = (np.cumsum(ones) - ones).astype(np.uint32)
        self.fingerprints, self.counts = np.zeros(len(keys), np.uint16), np.zeros(len(keys), values.dtype)
        if len(keys):
            at, who = self._index(np.concatenate(placed_at)), np.concatenate(placed)
            self.fingerprints[at], self.counts[at] = self._print(keys[who]), values[who]

    @staticmethod
    def _print(keys: np.ndarray) -> np.ndarray:
        return (mix(keys, 77) >> np.uint64(48)).astype(np.uint16)

    def _index(self, position: np.ndarray) -> np.ndarray:
        word = position >> 6
        below = (np.uint64(1) << (position & 63).astype(np.uint64)) - np.uint64(1)
        return self.rank[word].astype(np.int64) + np.bitwise_count(self.words[word] & below).astype(np.int64)

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """Counts of the keys, 0 for a key that has no slot or another fingerprint than the slot's key."""
        out, left = np.zeros(len(keys), np.int64), np.arange(len(keys))
        for level, (base, m) in enumerate(self.levels):
            if not len(left):
                break
            position = base + (mix(keys[left], level) % np.uint64(m)).astype(np.int64)
            there = (self.words[position >> 6] >> (position & 63).astype(np.uint64)) & np.uint64(1) == 1
            at, who = self._index(position[there]), left[there]
            same = self.fingerprints[at] == self._print(keys[who])
            out[who[same]] = self.counts[at[same]]
            left = left[~there]
        return out

    def known(self, keys: np.ndarray) -> np.ndarray:
        """Counts of keys that are all in the index."""
        out = self.lookup(keys)
        if len(out) and not out.all():
            raise ValueError("a line is not in the index of its own documents")
        return out

    def nbytes(self) -> int:
        return self.words.nbytes + self.rank.nbytes + self.fingerprints.nbytes + self.counts.nbytes


class _Lines:
    """The lines of some texts: their keys' hashes (0: blank), and how many each text has."""

    def __init__(self, part):
        self.texts = [x.as_py() or b"" for x in column(part, "text").cast(pa.binary())]
        self.lines = [t.split(b"\n") for t in self.texts]
        keys = [line.strip().lower() for ls in self.lines for line in ls]
        self.hashes = np.fromiter((xxhash.xxh3_64_intdigest(k) or 1 if k else 0 for k in keys), np.uint64, len(keys))
        self.many = np.fromiter(map(len, self.lines), np.int64, len(self.lines))

    def judged(self, part, drop: np.ndarray) -> pa.RecordBatch:
        """The rows of the part, less the lines where `drop` holds."""
        starts = np.cumsum(self.many) - self.many
        dropped = np.add.reduceat(drop, starts, dtype=np.int64) if len(starts) else np.zeros(0, np.int64)
        kept = [t if not d else b"\n".join(x for x, gone in zip(ls, drop[s : s + len(ls)]) if not gone) for t, ls, s, d in zip(self.texts, self.lines, starts, dropped)]
        return pa.RecordBatch.from_arrays([*part.columns, pa.array(self.many), pa.array(dropped), pa.array(kept, pa.binary()).cast(pa.string())], names=[*part.schema.names, "n_lines", "n_dropped", "kept_text"])


def _dealt(keys: np.ndarray, shards: int):
    """(shard, range) of sorted keys."""
    shift = np.uint64(64 - (shards - 1).bit_length()) if shards > 1 else np.uint64(63)
    cuts = np.searchsorted(keys >> shift, np.arange(max(2, shards) + 1, dtype=np.uint64))
    return [(int(s), slice(cuts[s], cuts[s + 1])) for s in np.flatnonzero(np.diff(cuts))]


def _count(shards: int):
    def run(batches):
        held: list[tuple] = []

        def emit():
            keys, counts = held[0]
            dealt = _dealt(keys, shards)
            return pa.RecordBatch.from_arrays(
                [pa.array([s for s, _ in dealt], pa.int32()), pa.array([keys[at].tobytes() for _, at in dealt], pa.binary()), pa.array([counts[at].tobytes() for _, at in dealt], pa.binary())],
                names=["shard", "hashes", "counts"],
            )

        for batch in batches:
            for part in chunks(batch, "text"):
                found = _Lines(part)
                of = np.repeat(np.arange(len(found.many)), found.many)[found.hashes > 0]
                keys = found.hashes[found.hashes > 0]
                order = np.lexsort((of, keys))
                keys, of = keys[order], of[order]
                first = np.r_[True, (keys[1:] != keys[:-1]) | (of[1:] != of[:-1])] if len(keys) else np.zeros(0, bool)
                held.append(summed(keys[first], np.ones(int(first.sum()), np.int64)))
                if sum(len(k) for k, _ in held) > _FLUSH:
                    held = [summed(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))]
                    if len(held[0][0]) > _FLUSH // 2:
                        yield emit()
                        held = []
        if held:
            held = [summed(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))]
            yield emit()

    return run


def _build(min_docs: int):
    small = np.uint8 if min_docs <= 0xFF else np.uint32
    most = np.iinfo(small).max

    def run(t: pa.Table) -> pa.Table:
        keys = np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in t["hashes"]])
        counts = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in t["counts"]])
        keys, counts = summed(keys, counts)
        index = PerfectHash(keys, np.minimum(counts, most).astype(small))
        return pa.table({"shard": t["shard"][:1].cast(pa.int32()), "n_keys": pa.array([len(keys)], pa.int64()), "n_bytes": pa.array([index.nbytes()], pa.int64()), "blob": pa.array([pickle.dumps(index, 5)], pa.binary())})

    return run


def build_index(docs: DataFrame, text_col: str = "text", min_docs: int = 10) -> tuple[DataFrame, int]:
    """The index as a table (shard, n_keys, n_bytes, blob) in the shared folder, and its number of shards."""
    shards = 1 << (pieces(docs, 64 << 20, 64) - 1).bit_length()
    counted = docs.select(named(docs, text_col).alias("text")).mapInArrow(lean(_count(shards)), "shard int, hashes binary, counts binary")
    built = counted.groupBy("shard").applyInArrow(lean(_build(min_docs)), "shard int, n_keys long, n_bytes long, blob binary")
    return stored(built, "line-index"), shards


def _probe(shared, shards: int, min_docs: int):
    def run(batches):
        index = {s: pickle.loads(blob) for s, blob in shared.value.items()}
        for batch in batches:
            for part in chunks(batch, "text"):
                found = _Lines(part)
                keys, which = np.unique(found.hashes, return_inverse=True)
                often = np.zeros(len(keys), bool)
                lines = keys > 0
                some = keys[lines]
                often[lines] = np.concatenate([index[s].known(some[at]) >= min_docs for s, at in _dealt(some, shards)]) if len(some) else False
                yield found.judged(part, often[which])

    return run


def _parts(t: pa.Table):
    for batch in t.to_batches():
        yield from chunks(batch, "text")


def _wanted(t: pa.Table) -> np.ndarray:
    """The distinct keys of a block of documents."""
    keys = sorted_distinct(np.concatenate([sorted_distinct(_Lines(part).hashes) for part in _parts(t)]))
    return keys[keys > 0]


def _ask(shards: int):
    def run(t: pa.Table) -> pa.Table:
        keys = _wanted(t)
        dealt = _dealt(keys, shards)
        return pa.table({"shard": pa.array([s for s, _ in dealt], pa.int32()), "block": pa.array([t["block"][0].as_py()] * len(dealt), pa.int32()), "hashes": pa.array([keys[at].tobytes() for _, at in dealt], pa.binary())})

    return run


def _answer(min_docs: int):
    def run(asked: pa.Table, known: pa.Table) -> pa.Table:
        out = []
        if len(asked):
            index = pickle.loads(known["blob"][0].as_py())
            out = [np.packbits(index.known(np.frombuffer(x.as_py(), np.uint64)) >= min_docs).tobytes() for x in asked["hashes"]]
        return pa.table({"block": asked["block"].cast(pa.int32()), "shard": asked["shard"].cast(pa.int32()), "often": pa.array(out, pa.binary())})

    return run


def _judge(shards: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        keys = _wanted(docs)
        often = np.zeros(len(keys), bool)
        got = dict(zip(answers["shard"].to_pylist(), answers["often"].to_pylist()))
        for s, at in _dealt(keys, shards):
            often[at] = np.unpackbits(np.frombuffer(got[s], np.uint8), count=at.stop - at.start).astype(bool)
        out = []
        for part in _parts(docs):
            found = _Lines(part)
            at = np.minimum(np.searchsorted(keys, found.hashes), max(0, len(keys) - 1))
            out.append(found.judged(part, (found.hashes > 0) & often[at] if len(keys) else np.zeros(len(found.hashes), bool)))
        return pa.Table.from_batches(out).drop_columns(["block"])

    return run


def line_dedup(docs: DataFrame, text_col: str = "text", min_docs: int = 10, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Every row of `docs` with n_lines, n_dropped and kept_text; lines found in `min_docs` documents are gone.

    Input columns of these three names are replaced.
    """
    kinds = {"n_lines": T.LongType(), "n_dropped": T.LongType(), "kept_text": T.StringType()}
    docs = without(docs, *kinds)
    index, shards = build_index(docs, text_col, min_docs)
    if (index.agg(F.sum("n_bytes")).first()[0] or 0) <= limit:
        shared = docs.sparkSession.sparkContext.broadcast({r.shard: bytes(r.blob) for r in index.select("shard", "blob").toLocalIterator()})
        return mapped(docs, {"text": text_col}, lean(_probe(shared, shards, min_docs)), **kinds)
    names, low = docs.columns, [c.lower() for c in docs.columns]
    at = names.index(text_col) if text_col in names else low.index(text_col.lower())
    plain = docs.toDF(*["text" if k == at else f"__{k}" for k in range(len(names))])
    blocks = pieces(docs, 8 << 20, 16)
    # written, so that a row keeps its block when a lost task runs again
    dealt = stored(plain.withColumn("block", F.pmod(F.xxhash64("text", F.monotonically_increasing_id()), F.lit(blocks)).cast("int")), "line-blocks")
    asked = dealt.select("block", "text").groupBy("block").applyInArrow(lean(_ask(shards)), "shard int, block int, hashes binary")
    answers = asked.groupBy("shard").cogroup(index.select("shard", "blob").groupBy("shard")).applyInArrow(lean(_answer(min_docs)), "block int, shard int, often binary")
    out = T.StructType(list(plain.schema.fields) + [T.StructField(k, v) for k, v in kinds.items()])
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(lean(_judge(shards)), out).toDF(*names, *kinds)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


OP5_SQL = """
WITH lines AS (
  SELECT doc_id, i, string_split(coalesce(text, ''), chr(10))[i] AS line
  FROM documents, LATERAL (SELECT unnest(generate_series(1, len(string_split(coalesce(text, ''), chr(10))))) AS i) s),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
often AS (SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(often.k) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE often.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN often USING (k) GROUP BY doc_id
"""
