"""Periodic runs, token counts and spelling groups against brute force, and on odd inputs."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sqlsift.llm import runs, spelling, token_counts

ODD = [(1, None), (2, ""), (None, "  \n"), (None, None), (3, "a"), (3, "a"), (4, "la " * 20_000), (5, "x" * 300_000), (6, "né " * 30 + "end <|endoftext|> 'll don't  go\n\n  on")]


def odd(spark, extra=()):
    rows = [(k, t, 1, "r") for k, t in [*ODD, *extra]]
    return spark.createDataFrame(rows, "doc_id long, text string, `a.b``c` int, RUNS string")


def brute_runs(x, least):
    x, out = np.array(x), []
    n = len(x)
    for q in range(1, n // 3 + 1):
        same = np.r_[False, x[q:] == x[:-q], False]
        for i, j in np.flatnonzero(same[1:] != same[:-1]).reshape(-1, 2).tolist():
            length = j - i + q
            if length >= max(least, 3 * q) and not any((x[i + r : i + length] == x[i : i + length - r]).all() for r in range(1, q)):
                out.append((i, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


stretch = st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=30), st.integers(1, 8), st.integers(0, 7))


@settings(max_examples=300, deadline=None)
@given(st.lists(stretch, max_size=6), st.sampled_from([2, 5, 10, 24, 24, 40]))
def test_runs_against_brute_force(parts, least):
    x = [w for unit, times, more in parts for w in unit * times + unit[:more]]
    assert runs.word_runs(np.array(x, np.int64), least) == brute_runs(x, least)


@pytest.mark.parametrize("x", [[0] * 5000, [0] * 2500 + [1] + [0] * 2500, ([0] * 200 + [1]) * 20, list(range(900)) * 4, [v for k in range(0, 3000, 8) for v in [*range(k, k + 8)] * 3], [i % 7 for i in range(99)] + [i % 5 for i in range(99)]])
def test_runs_at_all_scales(x):
    assert runs.word_runs(np.array(x, np.int64)) == brute_runs(x, 24)


def test_runs_query_against_brute_force(spark, tmp_path):
    rng = random.Random(3)
    rows = [(k, None if k % 50 == 0 else " \t\n"[k % 3].join(w for _ in range(rng.randint(0, 5)) for w in [rng.choice("abcdé") for _ in range(rng.randint(1, 30))] * rng.randint(1, 5))) for k in range(400)]
    spark.createDataFrame([*rows, (None, "a " * 30)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: tuple(r)[1:] for r in runs.op11_periodic_runs(spark, str(tmp_path)).collect()}
    for k, text in rows:
        w, h = (text or "").encode().split(), zlib.crc32(str(k).encode())
        n, g = len(w), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        found = brute_runs([w.index(v) for v in w], 24)
        gone = {i for s, m, q in found for i in range(s + q, s + m)}
        best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        head = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
        shas = [hashlib.sha256(x).hexdigest() for x in ("".join(f"{s},{m},{q}\n" for s, m, q in found).encode(), b" ".join(v for i, v in enumerate(w) if i not in gone))]
        assert got[k] == (len(found), *head, *shas)
    assert got[None][:4] == (1, 0, 30, 1) and sum(r[0] > 0 for r in got.values()) > 50


def test_runs_on_odd_input(spark):
    got = runs.periodic_runs(odd(spark))
    assert got.columns == ["doc_id", "text", "a.b`c", "runs", "collapsed"]
    rows = got.collect()
    assert len(rows) == len(ODD) and [tuple(x) for r in rows if r.doc_id == 4 for x in r.runs] == [(0, 20_000, 1)]
    assert [r.collapsed for r in rows if r.doc_id == 4] == ["la"] and {r.collapsed for r in rows if not (r.text or "").strip()} == {""}
    assert runs.periodic_runs(odd(spark).limit(0)).count() == 0
    with pytest.raises(ValueError):
        runs.periodic_runs(odd(spark), least=1)


@pytest.fixture(scope="module")
def machine():
    return token_counts.Machine(token_counts.tokenizer_path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_counts.tokenizer_path("byte_bpe_50k.json"))
    return lambda texts: [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]


PIECES = ["'", "s", "t", "re", "ve", "ll", "l", "r", " ", "  ", "\n", "\t", "\x85", "\xa0", " ", "​", "1", "२", "½", "é", "É", "ß", "漢字", "😀", "a", "aa", "the", "ing", " qu", "tion", "-", "==", "<|", "<|endoftext|>", "|>", "́"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.lists(st.sampled_from(PIECES), max_size=30).map("".join), st.text(max_size=40)), max_size=6))
def test_tokens_against_the_library(machine, library, texts):
    raw = [t.encode("utf-8", "ignore") for t in texts]
    got = machine.counts(b"".join(raw), np.r_[0, np.cumsum([len(r) for r in raw], dtype=np.int64)])
    assert got.tolist() == library([r.decode() for r in raw])


def test_tokens_of_long_texts(machine, library):
    rng = random.Random(5)
    text = "".join(rng.choice(PIECES) for _ in range(40_000)) + "b" * 30_000 + " " * 30_000 + "end"
    assert [machine.long(text.encode(), size) for size in (1 << 8, 1 << 12, 1 << 22)] == library([text]) * 3


def test_states_are_compiled_anew(machine, library, monkeypatch):
    monkeypatch.setattr(token_counts, "_STATES_KEPT", 50)
    machine.known.clear()
    texts = ["abcdefghijklmnopqrstuvwxyz" * 20, "qzxjqzxjv" * 30]
    assert [machine.of(t.encode()) for t in texts] == library(texts)


def test_tokens_on_odd_input(spark, library):
    got = token_counts.token_counts(odd(spark)).collect()
    assert len(got) == len(ODD) and sorted((r.n_bytes, r.n_tokens) for r in got) == sorted((len((t or "").encode()), library([t or ""])[0]) for _, t in ODD)
    assert token_counts.token_counts(odd(spark).limit(0)).columns == ["doc_id", "text", "a.b`c", "RUNS", "n_bytes", "n_tokens"]
    assert token_counts.token_counts(odd(spark).limit(0)).count() == 0


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_groups(words, ratio):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None
    out = {}
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None)
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_spelling_against_brute_force(spark, seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abé" if k % 2 else "aàáâzyx") for _ in range(rng.randint(6, 10))) for k in range(60)] + ["aaaaaa", "aaaaaaa", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "ababababab", "bababababa"]
    words = {}
    for w in base * 4:
        for _ in range(rng.randint(0, 2)):
            k = rng.randrange(len(w))
            w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abz") + w[k:], w[:k] + rng.choice("abz") + w[k + 1 :]])
        if len(w) >= 6:
            words[w] = rng.choice([5, 25, 125, 125, 625, 10_000])
    found = spelling.spelling_groups(spark.createDataFrame(list(words.items()), "word string, n long"))
    assert {r[0]: tuple(r)[1:] for r in found.collect()} == brute_groups(words, 5)
    assert max(v[3] for v in brute_groups(words, 5).values()) >= 3


def test_words_of_odd_input(spark):
    docs = odd(spark, [(7, "École ÉCOLE x×y Aé1b"), (None, "école")])
    got = dict(map(tuple, spelling.word_counts(docs).collect()))
    assert (got["École"], got["école"], got["x×y"], got["aé"], got["b"], got["la"]) == (2, 1, 1, 1, 1, 20_000)
    assert spelling.word_counts(docs.limit(0)).count() == 0 and spelling.spelling_groups(spelling.word_counts(docs.limit(0))).count() == 0


def test_altered_words(spark):
    rows = [(k, "wordy letters " * 3) for k in range(300)]
    got = dict(map(tuple, spelling.word_counts(spark.createDataFrame(rows, "doc_id long, text string"), alter=7).collect()))
    want = {}
    for k, _ in rows:
        for w in ("wordy", "letters"):
            h = zlib.crc32(f"{k}:{w}".encode())
            w = w if h % 7 else w[: h % len(w)] + w[h % len(w) + 1 :]
            want[w] = want.get(w, 0) + 3
    assert got == want
