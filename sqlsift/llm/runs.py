"""Periodic runs: stretches of words that repeat with a period q at least three times.

Block matching by scales. At scale B (a power of two) the blocks of B words that begin at multiples of B are the keys
of an automaton over integer sequences, which is run over the document. A run of a period q in [B, 2B) is 3q words long
or more, so its first length - q >= 2B words hold a whole aligned block, which occurs again q words on, inside the run. Periods
below the least scale show in its blocks too, as runs have `least` words. So every run has a seed: an aligned block and an
occurrence of it at a distance that its scale takes. A seed is extended word by word to both sides, exactly.

Three things keep this near linear and lose no run. A block whose first words do not occur again within 2B words
is no key. Blocks inside a known run of a period up to B/3 recur at each of its multiples: such seeds within one run only give multiples of its
period, and between two runs only a distance that brings their starts or their ends together can be a period.
Seeds in a stretch that was extended before at the same distance are in the same stretch.

Words are numbered within a document, and so are the stretches of 2, 4, 8 ... words at each place, from pairs of halves. A block's key
is its eight stretches, searched for at each offset in the numbers that many words apart: keys stay short at every scale.
A number is two symbols, so that no node of the automaton has very many children.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sqlsift.llm.common import column, lean, mapped, mix, sorted_distinct, table, without

LEAST, TIMES = 24, 3
#: A block is a key of so many numbers, of the stretches that it consists of.
_PARTS = 8
_LOW_BITS = 10
RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])


def _gaps(ids: np.ndarray, width: int) -> np.ndarray:
    """How far on the `width` words at each place occur next, very far if they do not (by hash: never too far)."""
    words = mix(ids.astype(np.uint64))
    n = len(ids) - width + 1
    with np.errstate(over="ignore"):
        grams = sum(words[k : k + n] * np.uint64(0x9E3779B97F4A7C15 * (2 * k + 1) & 0xFFFFFFFFFFFFFFFF) for k in range(width))
    order = np.argsort(grams, kind="stable")
    same = grams[order[1:]] == grams[order[:-1]]
    gaps = np.full(len(ids), np.iinfo(np.int64).max)
    gaps[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return gaps


def _doubled(names: np.ndarray, width: int) -> np.ndarray:
    """Numbers of the stretches of 2 * width words at each place, from those of `width` words; equal stretches have equal numbers."""
    pairs = names[: len(names) - width] * (int(names.max()) + 1) + names[width:]
    return np.unique(pairs, return_inverse=True)[1].astype(np.int64)


def _occurrences(names: np.ndarray, width: int, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key of each block of `size` words (by its number, -1 for none), then the start and key of every occurrence of one.

    `names` are the numbers of the stretches of `width` words: a block is a sequence of size / width of them.
    """
    parts = size // width
    high = int(names.max() >> _LOW_BITS) + 1
    symbols = np.stack([names >> _LOW_BITS, (names & (1 << _LOW_BITS) - 1) + high], 1)
    automaton, known = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE), {}
    key_at = np.full((len(names) + width) // size + 1, -1)
    for p in starts.tolist():
        block = tuple(symbols[p : p + size : width].ravel().tolist())
        key = known.setdefault(block, len(known))
        if key == len(known) - 1:
            automaton.add_word(block, key)
        key_at[p // size] = key
    automaton.make_automaton()
    found, keys = [], []
    for first in range(width):
        for end, key in automaton.iter(tuple(symbols[first::width].ravel().tolist())):
            found.append(first + ((end + 1) // 2 - parts) * width)
            keys.append(key)
    return key_at, np.array(found, np.int64), np.array(keys, np.int64)


def _agreeing(one: np.ndarray, other: np.ndarray) -> int:
    """How many leading elements agree."""
    n, at, step = min(len(one), len(other)), 0, 64
    while at < n:
        unlike = one[at : min(n, at + step)] != other[at : min(n, at + step)]
        k = int(unlike.argmax())
        if unlike[k]:
            return at + k
        at, step = at + step, 2 * step
    return n


def _hopeful(p: np.ndarray, d: np.ndarray, size: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Seeds that known runs of periods up to a third of a block do not settle."""
    fine = np.array(sorted((s, s + n, q) for s, n, q in runs if 3 * q <= size <= n), np.int64).reshape(-1, 3)
    if not len(fine):
        return np.ones(len(p), bool)

    def inside(at: np.ndarray) -> np.ndarray:  # two such runs share less than a block, so the last that begins before is the only one
        k = np.searchsorted(fine[:, 0], at, "right") - 1
        return np.where((k >= 0) & (fine[k, 1] >= at + size), k, -1)

    one, other = inside(p), inside(p + d)
    met = (fine[one, 1] + d == fine[other, 1]) | (fine[one, 0] + d == fine[other, 0])
    return (one < 0) | (other < 0) | ((one != other) & met)


def word_runs(ids: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a sequence of numbers, by start, then period.

    A run is a stretch of smallest period q and of max(least, 3q) elements or more that neither neighbour extends with that period.
    """
    n = len(ids)
    size = 1 << ((least + 1) // 3).bit_length() - 1
    if n < least:
        return []
    gaps = _gaps(ids, size)
    if not (gaps[::size] < n).any():
        return []
    runs: list[tuple[int, int, int]] = []
    lo, names, width = 1, ids, 1
    while TIMES * lo <= n:
        hi = 2 * size
        while width * _PARTS < size:
            names, width = _doubled(names, width), 2 * width
        starts = np.arange(0, n - size + 1, size)
        starts = starts[gaps[starts] < hi]
        if len(starts):
            key_at, at, key = _occurrences(names, width, starts, size)
            seeds, near = [], (at - lo) // size * size
            for p in (near, near - size) if lo == 1 else (near,):
                good = (p >= 0) & (at - p < hi)
                good[good] = key_at[p[good] // size] == key[good]
                seeds.append((at[good] - p[good]) * n + p[good])
            d, p = np.divmod(sorted_distinct(np.concatenate(seeds)), n)
            hopeful = _hopeful(p, d, size, runs)
            last, stop = 0, 0
            for d, p in zip(d[hopeful].tolist(), p[hopeful].tolist()):
                if d == last and p < stop:
                    continue
                last, stop = d, p + size + _agreeing(ids[p + size : n - d], ids[p + size + d :])
                begin = p - _agreeing(ids[:p][::-1], ids[d : p + d][::-1])
                length = stop + d - begin
                if length >= max(least, TIMES * d) and not any(d % q == 0 and s <= begin and s + m >= begin + length for s, m, q in runs):
                    runs.append((begin, length, d))
        lo, size = hi, hi
    return sorted(runs, key=lambda r: (r[0], r[2]))


def numbered(words: list[bytes]) -> np.ndarray:
    """Numbers of words, equal for equal ones."""
    known: dict[bytes, int] = {}
    return np.array([known.setdefault(w, len(known)) for w in words], np.int64)


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    if runs:
        edge = np.zeros(len(words) + 1, np.int64)
        for s, n, q in runs:
            edge[s + q] += 1
            edge[s + n] -= 1
        words = [w for w, k in zip(words, np.cumsum(edge).tolist()) if not k]
    return b" ".join(words)


def _run(least: int):
    out = pa.list_(pa.struct([pa.field(f.name, pa.int64()) for f in RUN.fields]))

    def run(batches):
        for batch in batches:
            found, texts = [], []
            for text in column(batch, "text").cast(pa.binary()):
                words = (text.as_py() or b"").split()  # of bytes: at the six ASCII white spaces
                runs = word_runs(numbered(words), least) if len(words) >= least else []
                found.append([{"start": s, "length": n, "period": q} for s, n, q in runs])
                texts.append(_collapsed(words, runs))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, out), pa.array(texts, pa.binary()).cast(pa.string())], names=[*batch.schema.names, "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, text_col: str = "text", least: int = LEAST) -> DataFrame:
    """Every row of `docs` with runs (array of start, length, period in words, by start, then period) and collapsed (the text without what repeats).

    Words are the pieces between ASCII white space. `collapsed` has the words joined by one space, less those that a run
    holds after its first period. Null and empty texts have no words: no runs, an empty text. Repeated rows, null ids and other
    columns stay as they are; input columns named runs or collapsed are replaced. Rows are judged one by one, whatever their length; nothing is shuffled.
    `least`: 2 or more.
    """
    if least < 2:
        raise ValueError("least must be 2 or more")
    docs = without(docs, "runs", "collapsed")
    return mapped(docs, {"text": text_col}, lean(_run(least)), runs=T.ArrayType(RUN), collapsed=T.StringType())


def planted(text, key):
    """`text`, or for each tenth key (by crc32 of its decimal form) its words with the last ones replaced by repetitions of a stretch."""
    h = F.crc32(key.cast("string"))
    g = F.floor(h / 10)
    words = F.array_remove(F.split(text, r"[ \t\n\x0B\f\r]+"), "")
    n = F.size(words).cast("long")
    a = g % F.greatest(n, F.lit(1))
    p = 1 + F.floor((n - a) / (3 + g % 8))
    again = F.flatten(F.array_repeat(F.slice(words, (a + 1).cast("int"), p.cast("int")), F.ceil((n - a) / p).cast("int")))
    return F.when((h % 10 == 0) & (n > 0), F.array_join(F.slice(F.concat(F.slice(words, F.lit(1), a.cast("int")), again), F.lit(1), n.cast("int")), " ")).otherwise(text)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = periodic_runs(docs.select("doc_id", planted(F.col("text"), F.col("doc_id")).alias("text")))
    best = F.aggregate("runs", F.lit(None).cast(RUN), lambda b, r: F.when(b.isNull() | (r["length"] * b["period"] > b["length"] * r["period"]), r).otherwise(b))
    listed = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))))
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return rows.select("doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("best.length * 1000 div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
