"""Packing: token sequences cut by dynamic programming, in document order.

Documents of a scan task are tokenized and laid end to end. Cuts are allowed at document ends (free),
sentence ends (a small penalty) and, in a stretch longer than a sequence, inside it (a large one). With
candidate cuts c_0 < c_1 < ... the least cost up to c_j is
    f(j) = penalty(j) + capacity - c_j + min over i with c_j - c_i <= capacity of (f(i) + c_i),
so a monotone queue of f(i) + c_i gives every transition in constant time. A task works on blocks of
about a million tokens and carries its last, unfilled sequence into the next block; only the last
sequence of a task is padded much, and one whose length is a power of two not at all. No shuffle.
`sequence_id` is the number of the scan task and the sequence in it: unique, but other splits of the
input give other ids.

With the public word vocabulary (checked when its file is opened) texts split at ASCII white space tokenize
word by word to the same ids, so a worker codes a word once and keeps those that come often, in bounded
memory. With any other tokenizer file whole texts are coded.

Defined results: a null or empty text is the end id alone; ids may be null or repeat; no row is dropped; an
empty table gives no pieces; of other columns, whatever their names, none is read or returned.
"""

from __future__ import annotations

import json
import os
import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from sqlsift.llm.common import KEPT, chunks, column, lean, named, ragged, table

CAPACITY = 2048
SENTENCE, INSIDE = 8, 96
_SPAN = 256
#: Fixed value: how the public word vocabulary splits a text.
_WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


class WordCoder:
    """Ids of texts; words that come often are kept, `most` and `most_bytes` of them at most."""

    def __init__(self, path: str | None, most: int = 400_000, most_bytes: int = 16 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer, models, pre_tokenizers

        path = path or public_tokenizers.path("word_bpe_49k.json")
        self.coder = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = [x.get("pattern", {}).get("Regex") for x in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        lowers = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        model = spec["model"]
        self.by_word = lowers and split == [_WORD_PATTERN, None] and spec.get("post_processor") is None and all(t["content"].startswith("<|") for t in spec["added_tokens"])
        if self.by_word:
            # the library's own cache only costs time here
            merges = [tuple(x) if isinstance(x, list) else tuple(x.split(" ")) for x in model["merges"]]
            self.coder.model = models.BPE(vocab=model["vocab"], merges=merges, end_of_word_suffix=model["end_of_word_suffix"], cache_capacity=0)
            # lower-case ASCII letters need neither normalizer nor pattern
            self.letters = Tokenizer(self.coder.model)
            self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            self.mark = self.coder.encode(";", add_special_tokens=False).ids[0]
        vocabulary = self.coder.get_vocab()
        ends = [i for t, i in vocabulary.items() if any(c in t for c in ".!?") and not any(c.isalnum() for c in t.removesuffix("</w>"))]
        self.ends = np.zeros(max(vocabulary.values()) + 2, bool)
        self.ends[ends] = True
        self.most, self.most_bytes = most, most_bytes
        self.index: dict[bytes, int] = {}
        self.starts, self.sizes, self.seen, self.pool, self.bytes = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32), 0

    def _coded(self, words: list[bytes], coder) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and how many each has. Words are coded in texts of some hundred, between marks that none of them holds."""
        found, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for lo in range(0, len(words), 6_000):
            some = [words[k : k + 300] for k in range(lo, min(lo + 6_000, len(words)), 300)]
            texts = coder.encode_batch_fast([b" ; ".join(ws).decode("utf-8", "replace") for ws in some], add_special_tokens=False)
            for ws, coded in zip(some, texts):
                ids = np.array(coded.ids, np.uint32)
                at = np.flatnonzero(ids == self.mark)
                if len(at) == len(ws) - 1:
                    found.append(np.delete(ids, at))
                    sizes.append(np.diff(np.r_[-1, at, len(ids)]) - 1)
                else:
                    found += (each := [np.array(x.ids, np.uint32) for x in coder.encode_batch_fast([w.decode("utf-8", "replace") for w in ws], add_special_tokens=False)])
                    sizes.append(np.array([len(x) for x in each], np.int64))
        return np.concatenate(found), np.concatenate(sizes)

    def _learn(self, new: list[bytes]) -> None:
        """Codes unseen words. Marks after letters are coded apart from them, as the pattern does."""
        cores = [w.rstrip(_MARKS) for w in new]
        plain = np.fromiter((c.isalpha() and c.islower() for c in cores), bool, len(new))
        letters = list(dict.fromkeys(c for c, p in zip(cores, plain) if p))
        tails = [w[len(c) :] for w, c, p in zip(new, cores, plain) if p]
        others = list(dict.fromkeys([w for w, p in zip(new, plain) if not p] + [t for t in set(tails) if t]))
        others.sort(key=lambda w: b";" in w)
        ids_a, size_a = self._coded(letters, self.letters)
        ids_b, size_b = self._coded(others, self.coder)
        size = np.r_[size_a, size_b, 0]
        start = np.cumsum(size) - size
        where = {w: k for k, w in enumerate(letters)}
        other = {w: len(letters) + k for k, w in enumerate(others)} | {b"": len(size) - 1}
        left = np.fromiter((where[c] if p else other[w] for w, c, p in zip(new, cores, plain)), np.int64, len(new))
        right = np.full(len(new), len(size) - 1)
        right[plain] = np.fromiter(map(other.__getitem__, tails), np.int64, len(tails))
        total = size[left] + size[right]
        begin = np.cumsum(total) - total
        out, ids = np.zeros(int(total.sum()), np.uint32), np.concatenate([ids_a, ids_b])
        out[ragged(begin, size[left])] = ids[ragged(start[left], size[left])]
        out[ragged(begin + size[left], size[right])] = ids[ragged(start[right], size[right])]
        self.index.update(zip(new, range(len(self.index), len(self.index) + len(new))))
        self.starts = np.concatenate([self.starts, begin + len(self.pool)])
        self.sizes, self.pool = np.concatenate([self.sizes, total]), np.concatenate([self.pool, out])
        self.seen = np.concatenate([self.seen, np.zeros(len(new), np.int64)])
        self.bytes += sum(map(len, new))

    def _thin(self) -> None:
        """Keeps the third of the bounds that came most often."""
        words = list(self.index)
        order = np.argsort(-self.seen, kind="stable")[: self.most // 3]
        order = order[np.fromiter((len(words[k]) <= 64 for k in order), bool, len(order))]
        order = np.sort(order[np.cumsum([len(words[k]) for k in order]) <= self.most_bytes // 3])
        self.index = {words[k]: i for i, k in enumerate(order.tolist())}
        sizes = self.sizes[order]
        self.pool = self.pool[ragged(self.starts[order], sizes)]
        self.starts, self.sizes, self.seen = np.cumsum(sizes) - sizes, sizes, self.seen[order] // 2
        self.bytes = sum(map(len, self.index))

    def encode(self, texts: list[bytes], end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, the end id after each text, and where each text ends."""
        if self.by_word:
            # folding before the tokenizer does is safe without its special tokens and without marks that compose
            each = [(t if b"<|" in t or b"\xcc" in t or b"\xcd" in t else t.lower()).split() for t in texts]
            flat = [w for ws in each for w in ws]
            if new := list(set(flat).difference(self.index)):
                self._learn(new)
            which = np.fromiter(map(self.index.__getitem__, flat), np.int64, len(flat))
            sizes = self.sizes[which]
            body = self.pool[ragged(self.starts[which], sizes)]
            ends = np.r_[0, np.cumsum(sizes)][np.cumsum([len(ws) for ws in each])]
            self.seen += np.bincount(which, minlength=len(self.seen))
            if len(self.index) > self.most or self.bytes > self.most_bytes:
                self._thin()
        else:
            each = [np.array(x.ids, np.uint32) for x in self.coder.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)]
            body, ends = np.concatenate(each), np.cumsum([len(x) for x in each])
        return np.insert(body, ends, end), ends + np.arange(1, len(texts) + 1)


def coder_of(path: str | None) -> WordCoder:
    """The coder of this worker: what it has learned serves the packing tasks after."""
    coders = KEPT.setdefault("packing", {})
    if path not in coders:
        coders[path] = WordCoder(path)
    return coders[path]


def choose(cuts: list[int], penalty: list[int], capacity: int = CAPACITY) -> list[int]:
    """The indexes of `cuts` (the first and last included) of least padding and penalties."""
    n = len(cuts)
    cost, back = [0] * n, [0] * n
    queue: deque[int] = deque([0])
    for j in range(1, n - 1):
        c = cuts[j]
        while c - cuts[queue[0]] > capacity:
            queue.popleft()
        i = queue[0]
        here = penalty[j] + capacity + cost[i]  # cost holds f + c
        cost[j], back[j] = here, i
        while queue and cost[queue[-1]] >= here:
            queue.pop()
        queue.append(j)
    last, i, best = n - 1, n - 2, None
    while i >= 0 and cuts[last] - cuts[i] <= capacity:
        size = cuts[last] - cuts[i]
        total = cost[i] - cuts[i] + (0 if size & (size - 1) == 0 else capacity - size)
        if best is None or total < best:
            best, back[last] = total, i
        i -= 1
    out = [last]
    while out[-1]:
        out.append(back[out[-1]])
    return out[::-1]


class _Packer:
    """Documents in, pieces out."""

    def __init__(self, first: int, capacity: int, block: int):
        self.next, self.capacity, self.block = first, capacity, max(block, 8 * capacity)
        self.keys: list = []  # of the documents held
        self.begin = np.zeros(0, np.int64)  # of each document, in the ids held
        self.done, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)  # ids of it packed before, ids of it in all
        self.ids, self.stops = np.zeros(0, np.uint32), np.zeros(0, np.int64)  # stops: ends of sentences
        self.columns: list[tuple] = []

    def add(self, keys: list, ids: np.ndarray, ends: np.ndarray, stops: np.ndarray) -> None:
        """Documents that end at `ends`."""
        base, begin = len(self.ids), np.r_[0, ends[:-1]]
        self.keys += keys
        self.begin = np.concatenate([self.begin, base + begin])
        self.done, self.size = np.concatenate([self.done, np.zeros(len(keys), np.int64)]), np.concatenate([self.size, ends - begin])
        self.ids, self.stops = np.concatenate([self.ids, ids]), np.concatenate([self.stops, base + stops])
        if len(self.ids) >= self.block:
            self.pack(final=False)

    def pack(self, final: bool) -> None:
        if not self.keys:
            return
        n = len(self.ids)
        borders = np.r_[self.begin, n]
        points = np.union1d(borders, self.stops)
        price = np.full(len(points), SENTENCE)
        price[np.searchsorted(points, borders)] = 0
        gaps = np.diff(points)
        step = min(_SPAN, self.capacity)
        far = np.flatnonzero(gaps > min(self.capacity, 4 * _SPAN))
        many = (gaps[far] - 1) // step
        forced = np.repeat(points[far], many) + step * (ragged(np.zeros(len(far), np.int64), many) + 1)
        cuts, price = np.concatenate([points, forced]), np.concatenate([price, np.full(len(forced), INSIDE)])
        order = np.argsort(cuts, kind="stable")
        chosen = cuts[order][choose(cuts[order].tolist(), price[order].tolist(), self.capacity)]
        stop = len(chosen) - 1 if final else max(1, len(chosen) - 2)
        limit = int(chosen[stop])
        edges = np.unique(np.concatenate([chosen[: stop + 1], self.begin[self.begin < limit]]))
        at, size = edges[:-1], np.diff(edges)
        owner, window = np.searchsorted(self.begin, at, "right") - 1, np.searchsorted(chosen, at, "right") - 1
        raw = memoryview(self.ids.astype("<u4").tobytes())
        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
        self.columns.append(([self.keys[k] for k in owner.tolist()], self.done[owner] + at - self.begin[owner], size, np.array(crc, np.int64), self.size[owner], self.next + window, at - chosen[window]))
        self.next += stop
        ahead = np.r_[self.begin[1:], n] > limit
        self.keys = [k for k, a in zip(self.keys, ahead.tolist()) if a]
        begin = self.begin[ahead] - limit
        self.done, self.size = self.done[ahead] + np.maximum(0, -begin), self.size[ahead]
        self.begin, self.ids, self.stops = np.maximum(0, begin), self.ids[limit:].copy(), self.stops[self.stops > limit] - limit

    def taken(self) -> list[tuple]:
        out, self.columns = self.columns, []
        return out


def _run(text: str, key: str, key_type: pa.DataType, path: str | None, end: int, capacity: int, block: int):
    def batches_of(found: list[tuple]):
        for keys, *rest in found:
            yield pa.RecordBatch.from_arrays([pa.array(keys, key_type), *map(pa.array, rest)], names=[key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    def run(batches):
        coder = coder_of(path)
        packer = _Packer(TaskContext.get().partitionId() << 32, capacity, block)
        for batch in batches:
            for part in chunks(batch, text):
                ids, ends = coder.encode([x.as_py() or b"" for x in column(part, text).cast(pa.binary())], end)
                packer.add(column(part, key).to_pylist(), ids, ends, np.flatnonzero(coder.ends[np.minimum(ids, len(coder.ends) - 1)]) + 1)
                yield from batches_of(packer.taken())
        packer.pack(final=True)
        yield from batches_of(packer.taken())

    return run


def pack(docs: DataFrame, text_col: str = "text", key_col: str = "doc_id", tokenizer: str | None = None, end_id: int = 1, capacity: int = CAPACITY, block: int = 1 << 20) -> DataFrame:
    """Pieces (key, start, length, ids_crc32, doc_tokens, sequence_id, offset) of all documents.

    `tokenizer`: path of a tokenizers file; None is the public word_bpe_49k.json of the worker. `capacity`: 1 or more.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    if capacity < 1 or block < 1 or end_id < 0:
        raise ValueError("capacity and block must be 1 or more, end_id 0 or more")
    rows = docs.select(named(docs, key_col), named(docs, text_col))
    names = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    out = T.StructType([T.StructField(key_col, rows.schema[key_col].dataType)] + [T.StructField(n, T.LongType()) for n in names])
    return rows.mapInArrow(lean(_run(text_col, key_col, to_arrow_type(rows.schema[key_col].dataType), tokenizer, end_id, capacity, block), "packing"), out)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
