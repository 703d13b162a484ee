"""N-gram Jaccard join: universe partition and pigeonhole, then exact verification.

Equal shingle sets are one class. A class of size n belongs to a size band; bands grow by the inverse of
the threshold, so partners lie in the same or the next band, and a class signs under its own scheme and the
one below. Two linked sets of a scheme differ in at most H tokens. Hashing deals all tokens into
m segments, so at least m - H segments are equal. The cost-based allocation chooses, for each scheme,
  * exact segments, m = H + 1 + slack: each set may leave out up to `slack` segments, namely its
    empty ones and those whose content more than `OFTEN` sets share; or
  * fewer segments with their one-deletion neighbourhoods, 2m > H (the cheaper plan for small sets).
A set with more than `slack` such segments is deficient and also meets others in the often-shared ones.
If both sets of a pair are deficient they meet there; otherwise one has an equal segment left that is
neither empty nor shared often, and they meet in it. No pair is lost.

Hash shards receive packed (key, class) arrays and give the pairs of small buckets; a large bucket gives its
rows and links to its least member only. Parity bitmaps drop pairs that cannot be linked. Round one verifies
for each class the best partner alone and joins what is proven into components; round two does so for the
nearest set in another component; the last verifies every candidate pair, and all pairs of deficient
sets in large buckets that the bitmaps leave possible, that still lie in different components.
Large buckets are cut into a grid of bounded cells. Sets are hashed to 64 bits, tokens too.

Defined results: no words or null text: size 0, linked with nothing; fewer words than a shingle: the whole
sequence is one; a null id takes no part and has a null component; repeated rows are one component, a row each; an empty
table gives none. Columns beside the id and the text are not read and do not come back.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlsift.llm.common import chunks, column, lean, mix, pieces, ragged, stored, table
from sqlsift.llm.components import components

WIDTH, PERCENT, OFTEN, CELL = 5, 80, 16, 2048
_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: list[bytes], width: int = WIDTH) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    index: dict[bytes, int] = {}
    each = [t.lower().split() for t in texts]
    flat = np.array([index.setdefault(w, len(index)) for ws in each for w in ws], np.int64)
    word = np.fromiter(map(xxhash.xxh3_64_intdigest, index), np.uint64, len(index))[flat] if len(flat) else np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        rolled = np.zeros(max(0, len(word) - width + 1), np.uint64)
        for j in range(width):
            rolled = rolled * _ODD + word[j : j + len(rolled)]
        rolled = mix(rolled)
        out, at = [], 0
        for ws in each:
            n = len(ws)
            if n >= width:
                out.append(np.unique(rolled[at : at + n - width + 1]))
            elif n:
                h = np.uint64(n)
                for w in word[at : at + n]:
                    h = h * _ODD + w
                out.append(mix(np.array([h], np.uint64), 5))
            else:
                out.append(np.zeros(0, np.uint64))
            at += n
    return out


def class_of(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes())


class Scheme:
    """How sets whose smaller partner lies in one size band are partitioned."""

    def __init__(self, top: int, bottom: int, percent: int):
        self.differ = int(top * (1 + 100 / percent) * (100 - percent) / (100 + percent) + 1e-9)
        slack = math.ceil(0.1 * (self.differ + 1)) + 2
        exact, few = self.differ + 1 + slack, self.differ // 2 + 1
        cost = exact * (1 + 4 * math.exp(-bottom / exact))
        if (bottom + few) * (1 + 4 * math.exp(1 - bottom / few)) < cost:
            self.segments, self.slack, self.deletions = few, 0, True
        else:
            self.segments, self.slack, self.deletions = exact, slack, False


class Schemes:
    def __init__(self, percent: int):
        self.percent, self.edges, self.known = percent, [max(1, math.ceil(percent / (100 - percent)))], []

    def upto(self, size: int) -> None:
        while self.edges[-1] <= size:
            bottom = self.edges[-1]
            self.edges.append(bottom * 100 // self.percent + 1)
            self.known.append(Scheme(self.edges[-1] - 1, bottom, self.percent))

    def of(self, sizes: np.ndarray) -> np.ndarray:
        """The band of each size, -1 below the least size that can have a partner."""
        self.upto(int(sizes.max(initial=0)))
        return np.searchsorted(np.array(self.edges), sizes, "right") - 1


_INFO = np.dtype([("cls", "<u8"), ("n", "<u4"), ("empty", "<u4", 2)])


def _signatures(sets: list[np.ndarray], schemes: Schemes):
    """Class information and, for every signature, its key and 2 * class + (0 own scheme, 1 the one below)."""
    sizes = np.array([len(s) for s in sets], np.int64)
    band = schemes.of(sizes)
    info = np.zeros(len(sets), _INFO)
    info["cls"] = [class_of(s) for s in sets]
    info["n"] = sizes
    keys, owners = [], []
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    value = mix(flat, 3)
    begin = np.cumsum(sizes) - sizes
    for low in (0, 1):
        for b in np.unique(band[band >= low]) - low:
            scheme = schemes.known[b]
            m, mine = scheme.segments, np.flatnonzero(band == b + low)
            at = ragged(begin[mine], sizes[mine])
            place = np.repeat(np.arange(len(mine)), sizes[mine]) * m + (mix(flat[at], 1000 + int(b)) % np.uint64(m)).astype(np.int64)
            order = np.argsort(place, kind="stable")
            sp, sv = place[order], value[at][order]
            starts = np.flatnonzero(np.r_[True, sp[1:] != sp[:-1]])
            full, total = sp[starts], np.add.reduceat(sv, starts)
            many = np.bincount(full // m, minlength=len(mine))
            none = m - many
            info["empty"][mine, low] = none
            emit = np.flatnonzero(none > scheme.slack)
            grid = np.ones((len(emit), m), bool)
            where = np.full(len(mine), -1)
            where[emit] = np.arange(len(emit))
            known = where[full // m] >= 0
            grid[where[full[known] // m], full[known] % m] = False
            r, c = np.nonzero(grid)
            seg, content, owner = [full % m, c], [total, np.zeros(len(r), np.uint64)], [full // m, emit[r]]
            if scheme.deletions:
                seg.append(sp % m)
                content.append(np.repeat(total, np.diff(np.r_[starts, len(sp)])) - sv)
                owner.append(sp // m)
            seg, content, owner = map(np.concatenate, (seg, content, owner))
            keys.append(mix(content ^ mix(seg.astype(np.uint64) + np.uint64(int(b) << 32), 9)))
            owners.append(2 * mine[owner] + low)
    return info, np.concatenate(keys) if keys else np.zeros(0, np.uint64), np.concatenate(owners) if owners else np.zeros(0, np.int64)


def _bitmap(s: np.ndarray) -> bytes:
    """512 parities: two sets differ in as many tokens at least as their bitmaps do in bits."""
    return np.packbits((np.bincount((mix(s, 21) & np.uint64(511)).astype(np.int64), minlength=512) & 1).astype(np.uint8)).tobytes()


def _wide_bitmap(s: np.ndarray) -> bytes:
    """Parities as in `_bitmap`, four to eight for each token of the set; halves fold onto each other by exclusive or."""
    m = max(512, 1 << (4 * len(s) - 1).bit_length())
    return np.packbits((np.bincount((mix(s, 22) & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1).astype(np.uint8)).tobytes()


def _classify(width: int):
    def run(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                sets = shingle_sets([x.as_py() or b"" for x in column(part, "text").cast(pa.binary())], width)
                cls = np.array([class_of(s) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
                none = np.array([not len(s) for s in sets], bool)
                yield pa.RecordBatch.from_arrays([column(part, "doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(cls, pa.int64(), mask=none), pa.array([_bitmap(s) for s in sets], pa.binary())], names=["doc_id", "n_shingles", "cls", "bits"])

    return run


def _sign(width: int, percent: int, shards: int):
    def run(batches):
        schemes, seen = Schemes(percent), set()
        held, size = [], 0

        def flush():
            info, keys, owner = _signatures(held, schemes)
            shard = (keys % np.uint64(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            cuts = np.searchsorted(shard[order], np.arange(shards + 1))
            out = []
            for s in np.flatnonzero(np.diff(cuts)):
                at = order[cuts[s] : cuts[s + 1]]
                used, local = np.unique(owner[at] >> 1, return_inverse=True)
                out.append((s, (keys[at] >> np.uint64(32)).astype(np.uint32).tobytes(), (2 * local + (owner[at] & 1)).astype(np.uint32 if len(used) > 0x7FFF else np.uint16).tobytes(), info[used].tobytes()))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["shard", "keys", "owners", "info"]) if out else None

        for batch in batches:
            for part in chunks(batch, "text"):
                for s in shingle_sets([x.as_py() or b"" for x in column(part, "text").cast(pa.binary())], width):
                    if len(s) and (c := class_of(s)) not in seen:
                        seen.add(c)
                        held.append(s)
                        size += len(s)
                if size > 1 << 20:
                    if out := flush():
                        yield out
                    held, size = [], 0
        if held and (out := flush()):
            yield out

    return run


_MET = "kind string, a long, b long, bucket long, slack int"


def _meet(percent: int):
    """The pairs of small buckets (kind pair, b < a by class), large buckets' rows (row) and links to their least (star)."""

    def run(t: pa.Table) -> pa.Table:
        keys, owner, info, base = [], [], [], 0
        for k, o, i in zip(t["keys"], t["owners"], t["info"]):
            k, i = np.frombuffer(k.as_py(), np.uint32), np.frombuffer(i.as_py(), _INFO)
            raw = o.as_py()
            o = np.frombuffer(raw, np.uint16 if len(raw) == 2 * len(k) else np.uint32).astype(np.int64)
            keys.append(k)
            owner.append(o + 2 * base)
            info.append(i)
            base += len(i)
        key, own, info = np.concatenate(keys), np.concatenate(owner), np.concatenate(info)
        classes, which = np.unique(info["cls"], return_inverse=True)
        first = np.zeros(len(classes), np.int64)
        first[which] = np.arange(len(info))
        n = info["n"][first].astype(np.int64)
        # a class that many tasks hold signs once
        code = np.unique(np.stack([key.astype(np.int64), which[own >> 1] * 2 + (own & 1)], 1), axis=0) if len(key) else np.zeros((0, 2), np.int64)
        key, own = code[:, 0], code[:, 1]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        many = np.diff(np.r_[starts, len(key)])
        cls = own >> 1
        found = [np.zeros((0, 2), np.int64)]
        for size in range(2, OFTEN + 1):
            rows = starts[many == size]
            for i in range(size):
                for j in range(i):
                    a, b = cls[rows + i], cls[rows + j]
                    small, large = np.minimum(n[a], n[b]), np.maximum(n[a], n[b])
                    ok = (a != b) & (100 * small >= percent * large)
                    found.append(np.stack([np.maximum(a, b)[ok], np.minimum(a, b)[ok]], 1))
        pairs = np.concatenate(found)
        as_id = classes.view(np.int64)
        shard = int(t["shard"][0].as_py())
        often = np.flatnonzero(many > OFTEN)
        rows = ragged(starts[often], many[often])
        bucket = np.repeat(key[starts[often]] + (shard << 32), many[often])
        hub = np.repeat(cls[starts[often]], many[often])
        schemes = Schemes(percent)
        band = schemes.of(n)
        slack = np.array([s.slack for s in schemes.known] or [0], np.int64)
        c, low = cls[rows], own[rows] & 1
        left = slack[np.maximum(0, band[c] - low)] - info["empty"][first[c], low] if len(rows) else np.zeros(0, np.int64)
        star = hub != c
        return pa.table({
            "kind": pa.array(["pair"] * len(pairs) + ["star"] * int(star.sum()) + ["row"] * len(rows), pa.string()),
            "a": np.concatenate([as_id[pairs[:, 0]], as_id[c[star]], as_id[c]]),
            "b": np.concatenate([as_id[pairs[:, 1]], as_id[hub[star]], low]),
            "bucket": np.concatenate([np.zeros(len(pairs) + int(star.sum()), np.int64), bucket]),
            "slack": pa.array(np.concatenate([np.zeros(len(pairs) + int(star.sum()), np.int64), left]).astype(np.int32), pa.int32()),
        })

    return run


def _sets(width: int):
    def run(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                for s, want in zip(shingle_sets([x.as_py() or b"" for x in column(part, "text").cast(pa.binary())], width), column(part, "cls").to_pylist()):
                    if np.uint64(class_of(s)).astype(np.int64) == want:
                        yield pa.RecordBatch.from_arrays([pa.array([want], pa.int64()), pa.array([len(s)], pa.int64()), pa.array([_wide_bitmap(s)], pa.binary()), pa.array([s.tobytes()], pa.binary())], names=["cls", "n", "wide", "tokens"])

    return run


def _verify(percent: int):
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            at = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(at), batch.column(1).filter(at)], names=["u", "v"])

    return run


def _possible(percent: int):
    """Of (a, b, times, n and bitmap of each) the pairs whose bitmaps allow a link."""

    def run(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(-1, 8) for c in (4, 6))
            differ = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
            total = batch.column(3).to_numpy() + batch.column(5).to_numpy()
            at = pa.array(differ * (100 + percent) <= total * (100 - percent), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(at) for k in range(3)], names=["a", "b", "times"])

    return run


def _close(percent: int):
    """Of (a, b, n and wide bitmap of each) the pairs whose wide bitmaps allow a link."""

    def run(batches):
        for batch in batches:
            keep = []
            for nx, x, ny, y in zip(*(batch.column(c).to_pylist() for c in range(2, 6))):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                while len(x) != len(y):
                    x, y = (x, y) if len(x) > len(y) else (y, x)
                    x = x[: len(x) // 2] ^ x[len(x) // 2 :]
                keep.append(int(np.bitwise_count(x ^ y).sum()) * (100 + percent) <= (nx + ny) * (100 - percent))
            at = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(at) for k in range(2)], names=["a", "b"])

    return run


def _cells(percent: int, best: bool):
    """Pairs in one cell of a large bucket: other component, sizes and bitmaps that allow a link; `best`: for each set its nearest only."""

    def run(t: pa.Table) -> pa.Table:
        cls, root, n = (t[c].to_numpy() for c in ("cls", "root", "n"))
        side, (i, j) = t["part"].to_numpy(), (t["i"][0].as_py(), t["j"][0].as_py())
        bits = np.frombuffer(b"".join(t["bits"].to_pylist()), np.uint64).reshape(-1, 8)
        left, right = np.flatnonzero(side == i), np.flatnonzero(side == j)
        out = [np.zeros((0, 2), np.int64)]
        for lo in range(0, len(left), 256):
            l = left[lo : lo + 256]
            total = n[l][:, None] + n[right]
            differ = sum(np.bitwise_count(bits[l][:, None, w] ^ bits[right][:, w]).astype(np.int32) for w in range(8))
            ok = (root[l][:, None] != root[right]) & (100 * np.minimum(n[l][:, None], n[right]) >= percent * np.maximum(n[l][:, None], n[right])) & (differ * (100 + percent) <= total * (100 - percent))
            if i == j:
                ok &= l[:, None] < right
            if best and ok.any():
                far = np.where(ok, differ, 1 << 20)
                near = np.zeros_like(ok)
                near[np.arange(len(l)), far.argmin(axis=1)] = True
                near[far.argmin(axis=0), np.arange(len(right))] = True
                ok &= near
            r, c = np.nonzero(ok)
            x, y = cls[l[r]], cls[right[c]]
            out.append(np.stack([np.maximum(x, y), np.minimum(x, y)], 1))
        pairs = np.concatenate(out)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return run


def _proven(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that link. Wide bitmaps, a sixteenth to an eighth of the sets' bytes, meet first; only sets they leave travel."""
    near = pairs.select("a", "b")
    for side in ("a", "b"):
        near = near.join(sets.select(F.col("cls").alias(side), F.col("n").alias(f"n{side}"), F.col("wide").alias(f"wide{side}")), side)
    near = stored(near.select("a", "b", "na", "widea", "nb", "wideb").mapInArrow(lean(_close(percent)), "a long, b long"), "near-pairs")
    needed = near.select(F.col("a").alias("cls")).union(near.select("b")).distinct()
    few = 2 * near.count() <= 1 << 20  # 8 bytes each
    sets = sets.select("cls", "tokens").join(F.broadcast(needed) if few else needed, "cls", "left_semi")
    first = near.join(sets.select(F.col("cls").alias("a"), F.col("tokens").alias("x")), "a")
    both = first.join(sets.select(F.col("cls").alias("b"), F.col("tokens").alias("y")), "b").select("a", "b", "x", "y")
    return both.mapInArrow(lean(_verify(percent)), "u long, v long")


def near_components(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id: the least id reachable by links of Jaccard similarity `percent` or more."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    members = stored(docs.mapInArrow(lean(_classify(width)), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_shingles long, cls long, bits binary"), "classes")
    linked = docs.filter("doc_id is not null and text is not null")
    shards = pieces(docs, 16 << 20, 32)
    met = stored(linked.select("text").mapInArrow(lean(_sign(width, percent, shards)), "shard int, keys binary, owners binary, info binary").groupBy("shard").applyInArrow(lean(_meet(percent)), _MET), "met")
    sketch = stored(members.filter("doc_id is not null and cls is not null").dropDuplicates(["cls"]).select("cls", F.col("n_shingles").alias("n"), "bits"), "sketch")
    counted = met.filter("kind <> 'row'").groupBy("a", "b").agg(F.count("*").alias("times"))
    for side in ("a", "b"):
        counted = counted.join(sketch.select(F.col("cls").alias(side), F.col("n").alias(f"n{side}"), F.col("bits").alias(f"bits{side}")), side)
    pairs = stored(counted.select("a", "b", "times", "na", "bitsa", "nb", "bitsb").mapInArrow(lean(_possible(percent)), "a long, b long, times long"), "pairs")
    # deficient: more segments left out than the slack allows
    short = met.filter("kind = 'row'").groupBy(F.col("a").alias("cls"), F.col("b").alias("low")).agg(F.count("*").alias("n"), F.min("slack").alias("slack")).filter("n > slack").select("cls", "low")
    rows = stored(met.filter("kind = 'row'").select(F.col("a").alias("cls"), F.col("b").alias("low"), "bucket").join(short, ["cls", "low"]).select("bucket", "cls").distinct(), "buckets")
    wanted = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).union(rows.select("cls")).distinct()
    chosen = stored(members.filter("doc_id is not null and cls is not null").groupBy("cls").agg(F.min("doc_id").alias("doc_id")).join(wanted, "cls", "left_semi"), "chosen")
    few = chosen.count() <= 1 << 20  # 16 bytes each
    sets = stored(docs.join(F.broadcast(chosen) if few else chosen, "doc_id").select("cls", "text").mapInArrow(lean(_sets(width)), "cls long, n long, wide binary, tokens binary"), "sets")
    if sets.count() != sets.select("cls").distinct().count():  # an id that repeats with the same set
        sets = stored(sets.dropDuplicates(["cls"]), "sets")
    links = stored(_proven(pairs.groupBy("a").agg(F.max_by("b", F.struct("times", "b")).alias("b")), sets, percent), "proven")
    roots = stored(components(links), "roots")

    def rooted(df: DataFrame, of: str, name: str) -> DataFrame:
        return df.join(roots.select(F.col("node").alias(of), F.col("root").alias(name)), of, "left").withColumn(name, F.coalesce(name, of))

    # what is still apart: first the nearest set of another component for each, so that large groups join up, then all pairs
    for best in (True, False):
        apart = rooted(rooted(pairs, "a", "ra"), "b", "rb").filter("ra <> rb")
        apart = apart.groupBy("a").agg(F.max_by("b", F.struct("times", "b")).alias("b")) if best else apart.select("a", "b")
        placed = rooted(rows, "cls", "root")
        mixed = placed.groupBy("bucket").agg(F.count("*").alias("size"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("bucket", F.ceil(F.col("size") / CELL).cast("int").alias("parts"))
        cells = placed.join(mixed, "bucket").join(sketch, "cls").withColumn("part", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int"))
        cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("bucket", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "cls", "root", "n", "bits")
        crossed = cells.groupBy("bucket", "i", "j").applyInArrow(_cells(percent, best), "a long, b long")
        rest = stored(apart.union(crossed).distinct(), "open-pairs")
        if not rest.limit(1).count():
            break
        more = stored(_proven(rest, sets, percent), "proven")
        if more.limit(1).count():
            links = links.union(more)
            roots = stored(components(links), "roots")
    keyed = members.join(roots.select(F.col("node").alias("cls"), "root"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = keyed.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("least"))
    return keyed.join(least, "root", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id")).alias("component_id"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP10_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
r AS (SELECT doc_id, doc_id AS reach FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.reach = l.a)
SELECT d.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(reach) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN r USING (doc_id) GROUP BY d.doc_id
"""
