"""Language ID: multinomial naive Bayes over hashed character 1- to 3-grams.

Training counts n-grams of all labelled training texts: each task sums them into hash bins and sends
its sums once, in pieces of bins, so the shuffle has a few rows a task. The log-probability matrix
(bins x languages) is broadcast; scoring gathers its rows for a batch of texts and sums them by document in
numpy. A matrix of more than `max_cells` cells is cut into groups of languages, each learned and broadcast
by itself; documents pass them one after the other with what they found so far, to the same result.

Defined results: a null text or one without a letter (Unicode category L) is `und` with score 0; without training rows every
text is; ties take the smaller language; a score is the posterior of the language. Repeated rows are judged
each; an empty table gives an empty result; other columns stay, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sqlsift.llm.common import chunks, column, lean, mapped, named, stored, table, without

ORDERS = (1, 2, 3)
_LETTER = regex.compile(r"\p{L}")
_PIECES = 16


def _grams(texts: list[str], bins: int):
    """For each order: hash bins of all n-grams, and the text of each."""
    raw = [t.lower().encode("utf-32-le", "surrogatepass") for t in texts]
    codes = np.frombuffer(b"".join(raw), np.uint32).astype(np.uint64)
    sizes = np.array([len(r) // 4 for r in raw], np.int64)
    of = np.repeat(np.arange(len(texts)), sizes)
    rest = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(codes))
    shift = np.uint64(64 - (bins.bit_length() - 1))
    h = np.zeros(len(codes), np.uint64)
    with np.errstate(over="ignore"):
        for n in range(1, max(ORDERS) + 1):
            moved = codes[n - 1 :]
            h = h[: len(moved)] * np.uint64(0x2545F4914F6CDD1D) + moved + np.uint64(n)
            if n in ORDERS:
                inside = rest[: len(moved)] >= n
                yield ((h * np.uint64(0x9E3779B97F4A7C15)) >> shift)[inside].astype(np.int64), of[: len(moved)][inside]


def _learn(bins: int):
    def run(batches):
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in chunks(batch, "text", 1 << 20):
                langs = column(part, "lang").to_pylist()
                texts = column(part, "text").to_pylist()
                names = sorted(set(langs))
                which = np.array([names.index(x) for x in langs])
                for h, of in _grams(texts, bins):
                    sums = np.bincount(which[of] * bins + h, minlength=len(names) * bins).reshape(-1, bins)
                    for k, x in enumerate(names):
                        totals[x] = totals[x] + sums[k] if x in totals else sums[k]
        for x, sums in totals.items():
            out = [(x, p, s.astype(np.int64).tobytes()) for p, s in enumerate(np.split(sums, _PIECES))]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.string(), pa.int32(), pa.binary()))], names=["lang", "piece", "sums"])

    return run


def _add(t: pa.Table) -> pa.Table:
    total = None
    for x in t["sums"]:
        got = np.frombuffer(x.as_py(), np.int64)
        total = got.copy() if total is None else total + got
    return pa.table({"lang": t["lang"][:1], "piece": t["piece"][:1].cast(pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})


class Model:
    def __init__(self, langs: list[str], weights: np.ndarray, prior: np.ndarray):
        self.langs, self.weights, self.prior = langs, weights, prior

    def scores(self, texts: list[str]) -> np.ndarray:
        """Log posteriors up to a constant, texts x languages."""
        out = np.tile(self.prior, (len(texts), 1))
        for h, of in _grams(texts, len(self.weights)):
            for lo in range(0, len(h), 1 << 18):
                hh, oo = h[lo : lo + (1 << 18)], of[lo : lo + (1 << 18)]
                starts = np.flatnonzero(np.r_[True, oo[1:] != oo[:-1]])
                out[oo[starts]] += np.add.reduceat(self.weights[hh], starts, axis=0)
        return out


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", bins: int = 1 << 16, smoothing: float = 0.5, max_cells: int = 1 << 23) -> list[Model]:
    """A model from all rows with text and language, in groups of languages of `max_cells` cells at most; bins are a power of 2, 16 at least."""
    rows = labelled.select(named(labelled, text_col).alias("text"), named(labelled, lang_col).alias("lang")).filter("text is not null and lang is not null")
    sizes = sorted((r.lang, r.n) for r in rows.groupBy("lang").agg(F.count("*").alias("n")).toLocalIterator())
    total, each = sum(n for _, n in sizes), max(1, max_cells // bins)
    models = []
    for lo in range(0, len(sizes), each):
        names = [x for x, _ in sizes[lo : lo + each]]
        some = rows if len(names) == len(sizes) else rows.filter(F.col("lang").between(names[0], names[-1]))
        sums = some.mapInArrow(lean(_learn(bins)), "lang string, piece int, sums binary").groupBy("lang", "piece").applyInArrow(_add, "lang string, piece int, sums binary").toLocalIterator()
        counts = np.zeros((bins, len(names)))
        for r in sums:
            got = np.frombuffer(bytes(r.sums), np.int64)
            counts[r.piece * len(got) : (r.piece + 1) * len(got), names.index(r.lang)] = got
        weights = np.log((counts + smoothing) / (counts.sum(axis=0) + smoothing * bins))
        models.append(Model(names, weights, np.log(np.array([n for _, n in sizes[lo : lo + each]]) / total)))
    return models


def _grams_in(texts: list[str]) -> np.ndarray:
    return np.array([sum(max(0, len(t.lower()) - n + 1) for n in ORDERS) for t in texts], np.int64)


def _against(model, last: bool, per_gram: bool):
    """The best language so far of each text, its log score, and the sum of all scores against it; at the last group the results."""

    def run(batches):
        m = model.value if model else None
        for batch in batches:
            for part in chunks(batch, "text", 1 << 20):
                texts = [t or "" for t in column(part, "text").to_pylist()]
                names = part.schema.names
                if "lang_pred" in names:
                    lang, best, total, each = (column(part, c).to_pylist() for c in ("lang_pred", "__best", "__total", "per_gram"))
                    lang, best, total, each = np.array(lang, object), np.array(best), np.array(total), np.array(each)
                else:
                    lang, best, total, each = np.full(len(texts), "und", object), np.full(len(texts), -np.inf), np.zeros(len(texts)), np.zeros(len(texts))
                known = np.array([bool(m and _LETTER.search(t)) for t in texts], bool)
                if known.any():
                    s = m.scores(texts)
                    at = np.argmax(s, axis=1)
                    top = s[np.arange(len(texts)), at]
                    new = known & (top > best)
                    high = np.where(known, np.maximum(best, top), 0)
                    total = np.where(known, total * np.exp(best - high) + np.exp(s - high[:, None]).sum(axis=1), total)
                    best = np.where(known, high, best)
                    lang[new] = np.array(m.langs, object)[at[new]]
                    if per_gram:
                        each = np.where(new, (top - m.prior[at]) / np.maximum(_grams_in(texts), 1), each)
                out = {"lang_pred": pa.array(lang.tolist(), pa.string())}
                if last:
                    out["score"] = pa.array(np.where(lang == "und", 0, 1 / np.where(total > 0, total, 1)), pa.float64())
                    if per_gram:
                        out["per_gram"] = pa.array(each, pa.float64())
                else:
                    out |= {"__best": pa.array(best, pa.float64()), "__total": pa.array(total, pa.float64()), "per_gram": pa.array(each, pa.float64())}
                kept = [k for k, c in enumerate(names) if c not in ("lang_pred", "__best", "__total", "per_gram")]
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in kept], *out.values()], names=[*[names[k] for k in kept], *out])

    return run


def predict(docs: DataFrame, models: list[Model], text_col: str = "text", per_gram: bool = False) -> DataFrame:
    """Every row of `docs` with lang_pred and score; input columns of these names are replaced.

    `per_gram` adds the mean log-probability of an n-gram in lang_pred.
    """
    result = {"lang_pred": T.StringType(), "score": T.DoubleType()} | ({"per_gram": T.DoubleType()} if per_gram else {})
    state = {"lang_pred": T.StringType(), "__best": T.DoubleType(), "__total": T.DoubleType(), "per_gram": T.DoubleType()}
    docs = without(docs, *result)
    names = docs.columns
    columns = {"text": text_col}
    for k, model in enumerate(models or [None]):
        last = k >= len(models) - 1
        shared = docs.sparkSession.sparkContext.broadcast(model) if model else None
        run = lean(_against(shared, last, per_gram))
        if k:
            rest = docs.toDF(*[f"__{i}" if c.lower() != text_col.lower() else "text" for i, c in enumerate(names)], *state)
            kept = T.StructType(rest.schema.fields[: len(names)] + [T.StructField(c, t) for c, t in (result if last else state).items()])
            docs = rest.mapInArrow(run, kept).toDF(*names, *(result if last else state))
        else:
            docs = mapped(docs, columns, run, **(result if last else state))
        if not last:
            docs = stored(docs.toDF(*[f"_{i}" for i in range(len(docs.columns))]), "languages").toDF(*docs.columns)
            shared.unpersist()
    return docs


def fitting(judged: DataFrame, models: list[Model], lang_col: str = "lang") -> DataFrame:
    """The rows of `judged` (predicted with `per_gram`) whose n-grams are about as likely as their language's are.

    A posterior only compares the languages learned; this holds a text against all labelled texts of its language:
    its log-probability an n-gram must be nearer to their mean than to that of n-grams spread evenly over the bins.
    """
    even = {x: float(m.weights[:, k].mean()) for m in models for k, x in enumerate(m.langs)}
    rows = judged.filter(F.col(lang_col) == F.col("lang_pred")).groupBy("lang_pred").agg(F.avg("per_gram").alias("m")).collect()
    bounds = [(r.lang_pred, (r.m + even[r.lang_pred]) / 2) for r in rows]
    found = judged.sparkSession.createDataFrame(bounds, "lang_pred string, __half double")
    return judged.join(F.broadcast(found), "lang_pred", "left").filter(F.coalesce(F.col("per_gram") >= F.col("__half"), F.lit(True))).drop("__half")


def held_out(modulus: int):
    """Whether a document is kept from training: crc32 of its id as text, a null id as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % modulus == 0


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.filter(~held_out(5)))
    return predict(docs.select("doc_id", held_out(5).alias("held_out"), "text"), model).drop("text")
