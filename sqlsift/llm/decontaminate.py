"""Benchmark decontamination: a prefix-filtered containment join of item windows with documents.

The sets are item windows (10 consecutive words, or a whole shorter item); their tokens are word
trigrams in order (a window of one or two words is its own token). A window is contained only if all its
tokens are, so one token is a sufficient prefix: the rarest, by counts over all documents. Documents
join on these prefix tokens; position in the window and both lengths bound the start; the words of the
whole window are then compared. Nothing but the item index moves: up to `block_bytes` of item text are one
broadcast. A larger benchmark is joined block by block: the driver and the workers hold one block at a time, each pass
leaves only the occurrences it found, and these meet their documents at the end.

Defined results: null or empty texts have no words and no hits; items without id or words never occur;
an item id that repeats counts once; repeated documents are judged row by row; empty tables give no rows or no hits;
other columns stay, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sqlsift.llm.common import chunks, column, lean, mapped, named, stored, table, without

WINDOW = 10
_TOKEN = 3
#: Lower-cases A-Z and turns every other ASCII byte that is no word byte into a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


def _packed(ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Where `n` known words follow each other, and the number that stands for them."""
    if len(ids) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    known = np.ones(len(ids) - n + 1, bool)
    for j in range(n):
        known &= ids[j : len(ids) - n + 1 + j] >= 0
    at = np.flatnonzero(known)
    out = np.full(len(at), n, np.uint64)
    for j in range(n):
        out = (out << np.uint64(20)) | ids[at + j].astype(np.uint64)
    return at, out


class ItemIndex:
    """Windows of a block of items, and their tokens."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        of: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words(text)]
            for i in range(max(1, len(ids) - window + 1)) if ids else ():
                of.setdefault(tuple(ids[i : i + window]), set()).add(item)
        self.windows, self.items = list(of), [sorted(x) for x in of.values()]
        self.length = np.array([len(w) for w in self.windows], np.int64)
        self.ids = np.full((len(of), window), -2, np.int32)
        for k, w in enumerate(self.windows):
            self.ids[k, : len(w)] = w
        self.widths = sorted({min(_TOKEN, len(w)) for w in self.windows})
        each = [_packed(np.array(w, np.int64), min(_TOKEN, len(w)))[1] for w in self.windows]
        self.tokens = np.unique(np.concatenate(each)) if each else np.zeros(0, np.uint64)
        self._each = each

    def order(self, counts: np.ndarray) -> None:
        """Makes the rarest token of each window its prefix."""
        first = [np.searchsorted(self.tokens, t) for t in self._each]
        offset = np.array([int(np.argmin(counts[t])) for t in first], np.int64)
        prefix = np.array([t[o] for t, o in zip(first, offset)], np.int64)
        by = np.argsort(prefix, kind="stable")
        self.window, self.offset = by, offset[by]
        self.keys, self.starts = np.unique(prefix[by], return_index=True)
        self.many = np.diff(np.r_[self.starts, len(by)])
        self.keys = self.tokens[self.keys] if len(by) else self.tokens[:0]
        self._each = None

    def encode(self, flat: list[bytes]) -> np.ndarray:
        get = self.vocabulary.get
        return np.array([get(w, -1) for w in flat], np.int64)

    @staticmethod
    def match(ids: np.ndarray, widths: list[int], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of tokens that are in `keys`, and their index there."""
        at, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for n in widths if len(keys) else ():
            p, t = _packed(ids, n)
            k = np.minimum(np.searchsorted(keys, t), len(keys) - 1)
            same = keys[k] == t
            at.append(p[same])
            found.append(k[same])
        return np.concatenate(at), np.concatenate(found)

    def occurrences(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and window of each occurrence in documents that end at `ends` (words of all in a row)."""
        at, k = self.match(ids, self.widths, self.keys)
        starts, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for lo in range(0, len(at), 50_000):
            a, kk = at[lo : lo + 50_000], k[lo : lo + 50_000]
            many = self.many[kk]
            row = np.repeat(self.starts[kk], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            doc = np.searchsorted(ends, np.repeat(a, many), "right")
            w, start = self.window[row], np.repeat(a, many) - self.offset[row]
            begin = np.where(doc > 0, ends[np.maximum(doc - 1, 0)], 0)
            fits = (start >= begin) & (start + self.length[w] <= ends[doc])
            w, start = w[fits], start[fits]
            here = np.minimum(start[:, None] + np.arange(self.ids.shape[1]), len(ids) - 1)
            want = self.ids[w]
            same = ((ids[here] == want) | (want == -2)).all(axis=1)
            starts.append(start[same])
            found.append(w[same])
        return np.concatenate(starts), np.concatenate(found)


def _count(shared):
    def run(batches):
        index = shared.value
        total = np.zeros(len(index.tokens), np.int64)
        for batch in batches:
            for part in chunks(batch, "text"):
                flat: list[bytes] = []
                for x in column(part, "text").cast(pa.binary()):
                    flat += [*words(x.as_py()), b""]
                _, k = ItemIndex.match(index.encode(flat), index.widths, index.tokens)
                total += np.bincount(k, minlength=len(total))
        if len(at := np.flatnonzero(total)):
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["token", "n"])

    return run


class _Words:
    """The words of some texts in a row, and where each text ends."""

    def __init__(self, part):
        each = [words(x.as_py()) for x in column(part, "text").cast(pa.binary())]
        self.flat = [w for ws in each for w in ws]
        self.n = np.fromiter(map(len, each), np.int64, len(each))
        self.ends = np.cumsum(self.n)

    def found(self, index: ItemIndex):
        """Start and length of each occurrence of a window, and the items of each text."""
        start, w = index.occurrences(index.encode(self.flat), self.ends)
        items: list[set[str]] = [set() for _ in self.n]
        doc = np.searchsorted(self.ends, start, "right")
        for d, k in np.unique(np.stack([doc, w], 1), axis=0) if len(w) else ():
            items[d].update(index.items[k])
        return start, index.length[w], doc, items

    def judged(self, part, start: np.ndarray, length: np.ndarray, items: list) -> pa.RecordBatch:
        hit = np.zeros(len(self.flat) + 1, np.int64)
        np.add.at(hit, start, 1)
        np.add.at(hit, start + length, -1)
        covered = np.r_[0, np.cumsum(np.cumsum(hit[:-1]) > 0)]
        n_hit = covered[self.ends] - covered[self.ends - self.n]
        items = [sorted(x) for x in items]
        digest = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
        out = {"n_words": pa.array(self.n, pa.int64()), "n_hit": pa.array(n_hit, pa.int64()), "n_items": pa.array([len(x) for x in items], pa.int64()), "items_sha256": pa.array(digest, pa.string()), "items": pa.array(items, pa.list_(pa.string())), "contaminated": pa.array(n_hit > 0, pa.bool_())}
        return pa.RecordBatch.from_arrays([*part.columns, *out.values()], names=[*part.schema.names, *out])


def _judge(shared):
    def run(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                found = _Words(part)
                start, length, _, items = found.found(shared.value)
                yield found.judged(part, start, length, items)

    return run


def _find(shared):
    """What occurs in the texts that hold a window of this block: the words covered as (start, length), and the items."""

    def run(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                found = _Words(part)
                start, length, doc, items = found.found(shared.value)
                order = np.argsort(doc, kind="stable")
                used, first = np.unique(doc[order], return_index=True)
                start = (start - (found.ends - found.n)[doc])[order]
                spans = [np.unique(np.stack([a, b], 1), axis=0).astype("<i8").tobytes() for a, b in zip(np.split(start, first[1:]), np.split(length[order], first[1:]))] if len(used) else []
                yield pa.RecordBatch.from_arrays([column(part, "__row").take(pa.array(used)), pa.array(spans, pa.binary()), pa.array([sorted(items[d]) for d in used], pa.list_(pa.string()))], names=["__row", "spans", "found"])

    return run


def _join_up(batches):
    """Documents with what all blocks found in them."""
    for batch in batches:
        for part in chunks(batch, "text"):
            found = _Words(part)
            begin = found.ends - found.n
            spans = [np.frombuffer(b"".join(x or []), "<i8").reshape(-1, 2) for x in column(part, "spans").to_pylist()]
            items = [{y for some in x or [] for y in some} for x in column(part, "found").to_pylist()]
            start = np.concatenate([x[:, 0] + b for x, b in zip(spans, begin)] + [np.zeros(0, np.int64)])
            length = np.concatenate([x[:, 1] for x in spans] + [np.zeros(0, np.int64)])
            yield found.judged(part.drop_columns(["__row", "spans", "found"]), start, length, items)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW, block_bytes: int = 4 << 20) -> DataFrame:
    """Every row of `docs` with n_words, n_hit, n_items, items_sha256, items and contaminated.

    `benchmark` has item_id and text. Input columns with the names of results are replaced.
    """
    kinds = {"n_words": T.LongType(), "n_hit": T.LongType(), "n_items": T.LongType(), "items_sha256": T.StringType(), "items": T.ArrayType(T.StringType()), "contaminated": T.BooleanType()}
    docs = without(docs, *kinds)
    items = benchmark.select(named(benchmark, "item_id").cast("string").alias("item"), named(benchmark, "text").cast("binary").alias("text")).filter("item is not null and text is not null")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    texts, sc = docs.select(named(docs, text_col).alias("text")), docs.sparkSession.sparkContext

    def ordered(b: int):
        """The index of a block, its prefixes chosen by counts over all documents, as a broadcast."""
        rows = items.filter(F.expr(f"pmod(xxhash64(item, text), {blocks}) = {b}")).toLocalIterator()
        index = ItemIndex([(r.item, bytes(r.text)) for r in rows], window)
        plain = sc.broadcast(index)
        counts = np.zeros(len(index.tokens), np.int64)
        for r in texts.mapInArrow(lean(_count(plain)), "token int, n long").groupBy("token").agg(F.sum("n").alias("n")).toLocalIterator():
            counts[r.token] = r.n
        plain.unpersist()
        index.order(counts)
        return sc.broadcast(index)

    if blocks == 1:
        return mapped(docs, {"text": text_col}, lean(_judge(ordered(0))), **kinds)
    names, low = docs.columns, [c.lower() for c in docs.columns]
    at = names.index(text_col) if text_col in names else low.index(text_col.lower())
    plain = docs.toDF(*["text" if k == at else f"__{k}" for k in range(len(names))])
    numbered = stored(plain.withColumn("__row", F.monotonically_increasing_id()), "decontamination-rows")
    found = None
    for b in range(blocks):
        shared = ordered(b)
        part = stored(numbered.select("__row", "text").mapInArrow(lean(_find(shared)), "__row long, spans binary, found array<string>"), "occurrences")
        shared.unpersist()
        found = part if found is None else found.union(part)
    found = found.groupBy("__row").agg(F.collect_list("spans").alias("spans"), F.collect_list("found").alias("found"))
    out = T.StructType(list(plain.schema.fields) + [T.StructField(k, v) for k, v in kinds.items()])
    return numbered.join(found, "__row", "left").mapInArrow(lean(_join_up), out).toDF(*names, *kinds)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, bench = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    return decontaminate(docs, bench).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP1_SQL = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, dw.n, i, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, cast(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, cast(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
