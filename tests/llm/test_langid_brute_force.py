"""Naive Bayes by plain Python over the same hashed n-grams; what counts as a letter; ties."""

import math
import random

import pytest

from sqlsift.llm import langid

BINS, SMOOTHING, MASK = 1 << 10, 0.5, (1 << 64) - 1


def bins_of(text):
    codes = [ord(c) for c in text.lower()]
    for k in range(len(codes)):
        h = 0
        for n in (1, 2, 3):
            if k + n <= len(codes):
                h = (h * 0x2545F4914F6CDD1D + codes[k + n - 1] + n) & MASK
                yield (h * 0x9E3779B97F4A7C15 & MASK) >> 64 - 10


def learned(rows):
    counts = {}
    for text, lang in rows:
        c = counts.setdefault(lang, [0] * BINS)
        for b in bins_of(text):
            c[b] += 1
    prior = {x: math.log(sum(y == x for _, y in rows) / len(rows)) for x in counts}
    return {x: (prior[x], [math.log((v + SMOOTHING) / (sum(c) + SMOOTHING * BINS)) for v in c]) for x, c in sorted(counts.items())}


def judged(model, text):
    if not any(c.isalpha() for c in text or ""):
        return "und", 0.0
    score = {x: p + sum(w[b] for b in bins_of(text)) for x, (p, w) in model.items()}
    best = min(score, key=lambda x: (-score[x], x))
    return best, 1 / sum(math.exp(s - score[best]) for s in score.values())


def test_against_brute_force(spark):
    rng = random.Random(4)
    of = {"aa": "abcde é", "bb": "cdefg ñ", "cc": "efghi ß"}
    rows = [("".join(rng.choice(of[x]) for _ in range(rng.randint(1, 60))), x) for x in of for _ in range(40)]
    model = langid.train(spark.createDataFrame(rows, "text string, lang string"), bins=BINS, smoothing=SMOOTHING)
    texts = [t for t, _ in rows] + [None, "", "½ ² ① Ⅷ", "12 _ !", "²a", "e", "É", "漢"] + rng.choices([t for t, _ in rows], k=10)
    got = langid.predict(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, text string"), model).orderBy("k").collect()
    plain = learned(rows)
    for r, t in zip(got, texts):
        lang, score = judged(plain, t)
        assert r.lang_pred == lang and r.score == pytest.approx(score)


def test_ties_take_the_smaller_language(spark):
    rows = [("same text", "zz"), ("same text", "mm"), ("same text", "bb")]
    model = langid.train(spark.createDataFrame(rows, "text string, lang string"), bins=BINS)
    r = langid.predict(spark.createDataFrame([("same",)], "text string"), model).first()
    assert r.lang_pred == "bb" and r.score == pytest.approx(1 / 3)
