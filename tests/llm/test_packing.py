"""Packing: any capacity, any tokenizer file, bounded words, odd columns."""

from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sqlsift.llm import packing

TEXTS = ["J̌ ÉtÉ é H̱x", "it's I'LL we''re ..x.. a;b ;; ;", "x" * 5000, None, "", "Wort... (Satz!) 12%,;", "<|endoftext|> A<|ENDOFTEXT|>, a|> Q.", "KK İ ẞ \x1c \x85 ﬀ", "tail-%%% tail-%%% __x__ 'tis 's"] * 3


def restored(rows, capacity):
    """The ids lie end to end: pieces of each document, and sequences without gaps."""
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.k].append((r.start, r.length, r.doc_tokens))
        sequences[r.sequence_id].append((r.offset, r.length))
    for pieces in docs.values():
        at = 0
        for start, length, total in sorted(pieces):
            assert start == at and length > 0
            at += length
        assert at == total
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    return {k: v[0][2] for k, v in docs.items()}


@pytest.mark.parametrize("file", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_of_words_are_ids_of_texts(file):
    path = public_tokenizers.path(file)
    coder, whole = packing.WordCoder(path, most=6, most_bytes=200), Tokenizer.from_file(path)
    for _ in range(2):
        for some in (TEXTS, TEXTS[:1], TEXTS[3:5]):
            ids, ends = coder.encode([(t or "").encode() for t in some], 1)
            want = [[*whole.encode(t or "", add_special_tokens=False).ids, 1] for t in some]
            assert np.split(ids, ends[:-1])[0].tolist() == want[0] and ids.tolist() == [i for w in want for i in w]
            assert ends.tolist() == np.cumsum([len(w) for w in want]).tolist()
    assert coder.by_word == (file == "word_bpe_49k.json") and len(coder.index) <= 60


@pytest.mark.parametrize("capacity", [1, 7, 100, 128, 2048, 1 << 21])
def test_any_capacity(spark, capacity):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "`k` long, text string").repartition(2)
    got = restored(packing.pack(docs, key_col="k", capacity=capacity, block=500).collect(), capacity)
    assert len(got) == len(TEXTS)


def test_refuses_bad_parameters(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    for bad in ({"capacity": 0}, {"block": 0}, {"end_id": -1}):
        with pytest.raises(ValueError):
            packing.pack(docs, **bad)


def test_other_columns_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a", 1, 2, 3, 4)], "doc_id long, Text string, `offset` int, `a.b` int, `c``d` int, LENGTH int")
    rows = packing.pack(docs).collect()
    assert len(rows) == 1 and len(rows[0]) == 7 and packing.pack(docs.limit(0)).count() == 0
