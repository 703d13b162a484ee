"""LM scoring: context-tree weighting over binary-decomposed bytes, and a word baseline.

A byte is eight binary decisions; the node of a decision is (bits so far, last d bytes) for every depth d up
to `DEPTH`. Each node has a Krichevsky-Trofimov estimate of its counts, and its weighted probability is half
its own estimate and half the product of its children's, so a decision mixes the estimates of all depths with
weights the whole training text decides. Where a longer context was never seen, the mixture ends at the
longest one that was. A text is scored between an end mark on either side, frozen after training.

Documents lie in blocks by hash. A block sends its sorted distinct byte n-grams and word hashes, each with its count in
the block's training rows, packed, to shards: once, as what it learned and as what it asks. Shards add counts up, some
blocks at a time. An n-gram's shard is that of its last two context bytes, so a shard holds whole subtrees below
depth two; what the first two levels need is summed over shards (at most 256 * 255 nodes) and broadcast.
Answers come back to the block in the order asked. No model is broadcast and no vocabulary joined row by row; a shard
with many askers is copied and the askers dealt among the copies. Contexts are bounded, so a shard holds a bounded
number of n-grams however long the text.

Defined results: a null text is empty (its end is still scored); repeated rows and null ids are scored as
rows of their own; without training rows every decision has probability 1/2; an empty table gives an empty result; of
other columns none is read or returned. Words are hashed to 64 bits.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlsift.llm.common import chunks, column, lean, mix, named, ragged, sorted_distinct, stored, summed, table
from sqlsift.llm.langid import held_out

DEPTH = 5
_END = b"\xff"
_WORDS, _GRAMS = 0, 1


def grams(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For every byte and end: the `depth` bytes before it, the latest first, then itself, in one number; and the ends of texts."""
    raw = np.frombuffer(b"".join(_END * depth + t + _END for t in texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64) + 1
    starts = np.cumsum(sizes + depth) - sizes - depth
    g = np.zeros(max(0, len(raw) - depth), np.uint64)
    for back in range(1, depth + 1):
        g |= raw[depth - back : len(raw) - back].astype(np.uint64) << np.uint64(8 * (depth + 1 - back))
    g |= raw[depth:]
    return g[ragged(starts, sizes)], np.cumsum(sizes)


def _packed(keys: np.ndarray) -> bytes:
    """Sorted keys as byte planes of their differences, which compress well."""
    return np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def _shard_of(kind: int, keys: np.ndarray, depth: int, shards: int) -> np.ndarray:
    if kind == _GRAMS:
        keys = mix(keys >> np.uint64(8 * (depth - 1)))
    return (keys % np.uint64(shards)).astype(np.int64)


def _dealt(kind: int, keys: np.ndarray, depth: int, shards: int):
    """(shard, positions) of the keys, each shard's in order."""
    shard = _shard_of(kind, keys, depth, shards)
    order = np.argsort(shard, kind="stable")
    cuts = np.searchsorted(shard[order], np.arange(shards + 1))
    return [(int(s), order[cuts[s] : cuts[s + 1]]) for s in np.flatnonzero(np.diff(cuts))]


def _word_hashes(words) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _planes(counts: np.ndarray) -> bytes:
    return counts.astype(np.uint64).view(np.uint8).reshape(-1, 8).T.tobytes()


def _counts(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.int64).ravel()


def _texts(t: pa.Table):
    """The texts of a block and whether each is held out, some MB at a time."""
    for batch in t.select(["text", "held_out"]).to_batches():
        for part in chunks(batch, "text", 2 << 20):
            yield [x.as_py() or b"" for x in column(part, "text").cast(pa.binary())], column(part, "held_out").to_numpy(zero_copy_only=False)


def _word_codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text, a code for each word, and the hashes by code."""
    split = [t.lower().split() for t in texts]
    codes, found = pd.factorize(np.array([w for ws in split for w in ws], object))
    return np.array([len(w) for w in split], np.int64), codes.astype(np.int32), _word_hashes(found)


def _gather(depth: int, shards: int):
    """The distinct keys of a block, with their counts in its training rows."""

    def run(t: pa.Table) -> pa.Table:
        seen: list[list] = [[], []]  # n-grams of training rows, of held-out rows
        words = []
        for texts, held in _texts(t):
            for side in (0, 1):
                if some := [x for x, h in zip(texts, held) if h == side]:
                    seen[side].append(grams(some, depth)[0])
            n, codes, hashes = _word_codes(texts)
            words.append((hashes, np.bincount(codes, weights=np.repeat(~held, n), minlength=len(hashes)).astype(np.int64)))
        learned = np.concatenate(seen[0]) if seen[0] else np.zeros(0, np.uint64)
        seen[0] = []
        learned.sort()
        starts = np.flatnonzero(np.r_[True, learned[1:] != learned[:-1]]) if len(learned) else np.zeros(0, np.int64)
        keys, counts = learned[starts], np.diff(np.r_[starts, len(learned)])
        if seen[1]:
            del learned
            others = sorted_distinct(np.concatenate(seen[1]))
            others = others[keys[np.minimum(np.searchsorted(keys, others), len(keys) - 1)] != others] if len(keys) else others
            keys, counts = summed(np.concatenate([keys, others]), np.concatenate([counts, np.zeros(len(others), np.int64)]))
        found = {_GRAMS: (keys, counts), _WORDS: summed(np.concatenate([k for k, _ in words] or [np.zeros(0, np.uint64)]), np.concatenate([c for _, c in words] or [np.zeros(0, np.int64)]))}
        block = int(t["block"][0].as_py())
        rows = [(kind, s, block, _packed(k[at]), _planes(c[at])) for kind, (k, c) in found.items() for s, at in _dealt(kind, k, depth, shards)]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows), [pa.int32()] * 3 + [pa.binary()] * 2)], names=["kind", "shard", "part", "keys", "counts"])

    return run


_GATHERED = "kind int, shard int, part int, keys binary, counts binary"
_MODEL = "kind int, shard int, part int, keys binary, counts binary, n_in long, n_keys long, total long"
#: How many parts of a shard one task adds up at a time.
_TOGETHER = 64


def _merge(t: pa.Table) -> pa.Table:
    keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    asked = 0
    held: list[tuple] = []
    for k, c in zip(t["keys"], t["counts"]):
        k, c = _unpacked(k.as_py()), _counts(c.as_py())
        asked += len(k)
        held.append((k[c > 0], c[c > 0]))
        if sum(len(x) for x, _ in held) > max(1_000_000, len(keys)):
            keys, counts = summed(np.concatenate([keys, *[x for x, _ in held]]), np.concatenate([counts, *[x for _, x in held]]))
            held = []
    keys, counts = summed(np.concatenate([keys, *[x for x, _ in held]]), np.concatenate([counts, *[x for _, x in held]]))
    if "n_in" in t.column_names:
        asked = sum(t["n_in"].to_pylist())
    same = {c: pa.array([int(t[c][0].as_py())], pa.int32()) for c in ("kind", "shard", "part")}
    return pa.table({**same, "keys": pa.array([_packed(keys)], pa.binary()), "counts": pa.array([_planes(counts)], pa.binary()), "n_in": [asked], "n_keys": [len(keys)], "total": [int(counts.sum())]})


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for positive x: eight steps up, then Stirling's series."""
    y, out = x + 8, np.zeros_like(x)
    for k in range(8):
        out -= np.log(x + k)
    return out + (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3)


def _kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    a, b = n0.astype(float), n1.astype(float)
    return _lgamma(a + 0.5) + _lgamma(b + 0.5) - np.log(np.pi) - _lgamma(a + b + 1)


def _nodes(context_byte: np.ndarray, counts: np.ndarray):
    """Decision nodes (context * 256 + bits so far) of (context * 256 + byte) keys, with their counts of 0 and 1."""
    context, byte = context_byte >> np.uint64(8) << np.uint64(8), context_byte & np.uint64(255)
    ids, zero, one = [], [], []
    for t in range(8):
        ids.append(context | np.uint64(1 << t) | (byte >> np.uint64(8 - t)))
        bit = (byte >> np.uint64(7 - t)) & np.uint64(1) == 1
        zero.append(np.where(bit, 0, counts))
        one.append(np.where(bit, counts, 0))
    ids, zero, one = np.concatenate(ids), np.concatenate(zero), np.concatenate(one)
    order = np.argsort(ids, kind="stable")
    ids, zero, one = ids[order], zero[order], one[order]
    starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]]) if len(ids) else np.zeros(0, np.int64)
    return ids[starts], np.add.reduceat(zero, starts) if len(starts) else zero, np.add.reduceat(one, starts) if len(starts) else one


class Subtrees:
    """The levels of a shard from depth `low` to `depth`: node ids, counts, and log odds of a node against its children."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, depth: int, low: int = 2):
        self.levels: dict[int, tuple] = {}
        below = None
        for d in range(depth, low - 1, -1):
            drop = np.uint64(8 * (depth - d + 1))
            ids, zero, one = _nodes(*summed(((keys >> drop) << np.uint64(8)) | (keys & np.uint64(255)), counts))
            own = _kt(zero, one)
            odds, weighted = np.full(len(ids), np.inf), own
            if below is not None:
                child = self.up(*below)
                odds = own - child[1]
                weighted = np.logaddexp(own, child[1]) - np.log(2)
            self.levels[d], below = (ids, zero, one, odds), (ids, weighted)
        self.top = below

    @staticmethod
    def up(ids: np.ndarray, weighted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums of log weighted probabilities by parent: the earliest context byte goes."""
        parent = (ids >> np.uint64(16) << np.uint64(8)) | (ids & np.uint64(255))
        return summed(parent, weighted)


def _first_levels(depth: int):
    """What the shards know of depths 1 (by node): counts, and the sum of their children's log probabilities."""

    def run(batches):
        for batch in batches:
            for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys, counts = _unpacked(k), _counts(c)
                if not len(keys):
                    continue
                ids, zero, one = _nodes(*summed((keys >> np.uint64(8 * depth) << np.uint64(8)) | (keys & np.uint64(255)), counts))
                child = Subtrees.up(*Subtrees(keys, counts, depth).top)
                yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int64)), pa.array(zero), pa.array(one), pa.array(child[1])], names=["node", "zero", "one", "below"])

    return run


class Top:
    """Depths 0 and 1 as dense arrays."""

    def __init__(self, node: np.ndarray, zero: np.ndarray, one: np.ndarray, below: np.ndarray):
        self.zero, self.one, self.odds = np.zeros((2, 1 << 16)), np.zeros((2, 1 << 16)), np.full((2, 1 << 16), np.inf)
        own = _kt(zero, one)
        self.zero[1][node], self.one[1][node], self.odds[1][node] = zero, one, own - below
        weighted = np.logaddexp(own, below) - np.log(2)
        root = node & 255
        for to, values in ((self.zero[0], zero), (self.one[0], one)):
            np.add.at(to, root, values)
        child = np.zeros(256)
        np.add.at(child, root, weighted)
        seen = np.unique(root)
        self.odds[0][seen] = _kt(self.zero[0][seen], self.one[0][seen]) - child[seen]


def log10_probability(keys: np.ndarray, top: Top, trees: Subtrees, depth: int) -> np.ndarray:
    """log10 of each n-gram's last byte given the bytes before it."""
    out = np.zeros(len(keys))
    byte = keys & np.uint64(255)
    for t in range(8):
        v = np.uint64(1 << t) | (byte >> np.uint64(8 - t))
        bit = (byte >> np.uint64(7 - t)) & np.uint64(1) == 1
        p, begun = np.full(len(keys), 0.5), np.zeros(len(keys), bool)
        for d in range(depth, -1, -1):
            node = (keys >> np.uint64(8 * (depth - d + 1)) << np.uint64(8)) | v
            if d >= 2:
                ids, zero, one, odds = trees.levels[d]
                if not len(ids):
                    continue
                at = np.minimum(np.searchsorted(ids, node), len(ids) - 1)
                seen = ids[at] == node
            else:
                at = (node if d else v).astype(np.int64)
                zero, one, odds = top.zero[d], top.one[d], top.odds[d]
                seen = zero[at] + one[at] > 0
            z, o = zero[at], one[at]
            own = (np.where(bit, o, z) + 0.5) / (z + o + 1)
            w = 1 / (1 + np.exp(-np.clip(odds[at], -700, 700)))
            p = np.where(seen, np.where(begun, w * own + (1 - w) * p, own), p)
            begun |= seen
        out += np.log10(p)
    return out


def _answer(top, depth: int):
    def run(asked: pa.Table, known: pa.Table) -> pa.Table:
        out = []
        if len(asked):
            kind, shard = int(asked["kind"][0].as_py()), int(asked["shard"][0].as_py())
            keys = _unpacked(known["keys"][0].as_py()) if len(known) else np.zeros(0, np.uint64)
            counts = _counts(known["counts"][0].as_py()) if len(known) else np.zeros(0, np.int64)
            trees = Subtrees(keys, counts, depth) if kind == _GRAMS else None
            for i in range(len(asked)):
                want = _unpacked(asked["keys"][i].as_py())
                if kind == _GRAMS:
                    value = np.concatenate([log10_probability(want[lo : lo + 100_000], top.value, trees, depth) for lo in range(0, len(want), 100_000)]).astype(np.float32)
                else:
                    at = np.minimum(np.searchsorted(keys, want), max(0, len(keys) - 1))
                    value = np.where(keys[at] == want, counts[at], 0) if len(keys) else np.zeros(len(want), np.int64)
                out.append((int(asked["part"][i].as_py()), kind, shard, value.tobytes()))
        cols = list(zip(*out)) or [()] * 4
        return pa.table([pa.array(c, k) for c, k in zip(cols, [pa.int32()] * 3 + [pa.binary()])], names=["block", "kind", "shard", "answer"])

    return run


def _score(depth: int, shards: int, total: int, distinct: int, ends: int, id_type: pa.DataType):
    floor = np.log10(total + 0.1 * (distinct + 1))

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        cols = {"doc_id": docs["doc_id"], "held_out": docs["held_out"]}
        parts = []
        for texts, _ in _texts(docs):
            g, upto = grams(texts, depth)
            codes, found = pd.factorize(g)
            parts.append((codes.astype(np.int32), found, upto, *_word_codes(texts)))
        keys = {_GRAMS: sorted_distinct(np.concatenate([x[1] for x in parts] + [np.zeros(0, np.uint64)])), _WORDS: sorted_distinct(np.concatenate([x[5] for x in parts] + [np.zeros(0, np.uint64)]))}
        value = {_WORDS: np.zeros(len(keys[_WORDS]), np.int64), _GRAMS: np.zeros(len(keys[_GRAMS]), np.float32)}
        got = {(k, s): a for k, s, a in zip(answers["kind"].to_pylist(), answers["shard"].to_pylist(), answers["answer"].to_pylist())}
        for kind in keys:
            for s, at in _dealt(kind, keys[kind], depth, shards):
                value[kind][at] = np.frombuffer(got[kind, s], value[kind].dtype)
        n_tokens, n_known, base, score = [], [], [], []
        for codes, found, upto, n, word, hashes in parts:
            each = value[_GRAMS][np.searchsorted(keys[_GRAMS], found)].astype(float)[codes]
            score.append(np.add.reduceat(each, np.r_[0, upto[:-1]]))
            count = value[_WORDS][np.searchsorted(keys[_WORDS], hashes)][word] if len(hashes) else np.zeros(0, np.int64)
            of = np.repeat(np.arange(len(n)), n)
            known = np.bincount(of, weights=count > 0, minlength=len(n)).astype(np.int64)
            logs = np.bincount(of, weights=np.log10(count + 0.1), minlength=len(n))
            n_tokens.append(n + 1)
            n_known.append(known + (ends > 0))
            base.append(logs + np.log10(ends + 0.1) - (n + 1) * floor)
        cols |= {k: pa.array(np.concatenate(v) if v else []).cast(kind) for k, v, kind in (("n_tokens", n_tokens, pa.int64()), ("n_known", n_known, pa.int64()))}
        cols["train_tokens"] = pa.array([total] * len(docs), pa.int64())
        cols |= {k: pa.array(np.concatenate(v) if v else []).cast(pa.float64()) for k, v in (("base_score", base), ("score", score))}
        return pa.table(cols)

    return run


def lm_scores(docs: DataFrame, training, text_col: str = "text", id_col: str = "doc_id", depth: int = DEPTH, shard_bytes: int = 7 << 20, block_bytes: int = 14 << 20, row_col: str | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row; rows where the column `training` holds are learned from.

    Rows are dealt into blocks by id and text. Where very many rows may have one id (or none) and one text, `row_col` names a column that tells
    them apart and is the same at each reading, such as the place of a row in its file. Other columns are not read and do not come back.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    if not 1 <= depth <= 7:
        raise ValueError("depth must be 1 to 7: an n-gram is one number")
    spark = docs.sparkSession
    rows = docs.select(named(docs, id_col).alias("doc_id"), F.coalesce(named(docs, text_col), F.lit("")).alias("text"), (~training).alias("held_out"), (named(docs, row_col) if row_col else F.lit(0)).alias("row"))
    ends, size = rows.agg(F.count_if(~F.col("held_out")), F.sum(F.octet_length("text") + 16)).first()
    shards, blocks = max(32, -(-(size or 0) // shard_bytes)), max(32, -(-(size or 0) // block_bytes))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text", "row"), F.lit(blocks)).cast("int")).drop("row").repartition(blocks, "block")
    gathered = stored(dealt.groupBy("block").applyInArrow(lean(_gather(depth, shards)), _GATHERED), "lm-gathered")
    model, left = gathered, blocks
    while True:  # at each level some parts become one
        left = -(-left // _TOGETHER)
        model = model.withColumn("part", (F.col("part") / _TOGETHER).cast("int")).groupBy("kind", "shard", "part").applyInArrow(lean(_merge), _MODEL)
        if left == 1:
            break
    model = stored(model, "lm")
    facts = {r.kind: r for r in model.groupBy("kind").agg(F.sum("n_in").alias("n_in"), F.sum("n_keys").alias("n_keys"), F.sum("total").alias("total")).collect()}
    first = model.filter(f"kind = {_GRAMS}").select("keys", "counts").mapInArrow(lean(_first_levels(depth)), "node long, zero long, one long, below double")
    first = first.groupBy("node").agg(F.sum("zero").alias("zero"), F.sum("one").alias("one"), F.sum("below").alias("below")).toPandas()
    top = spark.sparkContext.broadcast(Top(*(first[c].to_numpy() for c in ("node", "zero", "one", "below"))))
    words = facts.get(_WORDS)
    total, distinct = (words.total if words else 0) + ends, (words.n_keys if words else 0) + (ends > 0)
    copies = max([1, *(-(-f.n_in // max(1, 8 * f.n_keys)) for f in facts.values())])
    by = ("kind", "shard", "copy")
    asked = gathered.select("kind", "shard", F.pmod("part", F.lit(copies)).alias("copy"), "part", "keys").repartition(2 * shards, *by)
    known = model.select("kind", "shard", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"), "keys", "counts").repartition(2 * shards, *by)
    answers = asked.groupBy(*by).cogroup(known.groupBy(*by)).applyInArrow(lean(_answer(top, depth)), "block int, kind int, shard int, answer binary").repartition(blocks, "block")
    kind = rows.schema["doc_id"].dataType
    out = f"doc_id {kind.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(lean(_score(depth, shards, total, distinct, ends, to_arrow_type(kind))), out)


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("_metadata.row_index").alias("row"))
    return lm_scores(docs, ~held_out(10), row_col="row")
