"""Token counts by transducers compiled from a byte-level BPE tokenizer's file.

Two deterministic machines. The first reads characters and marks where pieces begin (the file's splitting pattern: contractions, words,
numbers, signs, white space). Its states are few, so a stretch of text is a map from states to states; these maps are a finite
set closed under composition, each one number, composed by a table. Texts are cut into columns of 64 characters, every
column's map is built for all columns at once, a parallel prefix scan over the columns gives the state in which each begins, and so the
state before every character.

The second reads the bytes of a piece; its transitions carry by how many tokens the count changes. A prefix of a piece
ends in exactly one token that its left neighbour may stand before (no merge of the file crosses between the two), so it
suffices to follow, for each place where a token could still be under way, its node in the tree of tokens, the token before it, and
the count there less the present one. Such a set is a state. States are compiled when a text first reaches them.

Kinds of characters are asked of the tokenizer library itself, once for each character that occurs. Added tokens are found first
and count one each, as the library does by default.
"""

from __future__ import annotations

import json
import re
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sqlsift.llm.common import KEPT, chunks, column, lean, mapped, table, without

#: Letters that end a contraction after an apostrophe by themselves, those that need a second one, with it.
ENDS, OPENS = "stmd", {"r": "e", "v": "e", "l": "l"}
#: Kinds of characters. DONE ends the text, ADDED is a further character of an added token. A kind plus FRESH is the same at the begin of a text.
LETTER, ENDING, OPENING, E, L, NUMBER, BLANK, SPACE, APOSTROPHE, SIGN, ADDED, DONE = range(12)
FRESH = 12
#: States: what stands before the next character. NEW: a piece ends here whatever comes. FIRST_*, MORE_*: one or more white space characters, of which the
#: last is a blank or another; QUOTE: an apostrophe that begins a piece, then with an r or v, or an l.
NEW, WORD, DIGITS, SIGNS, FIRST_BLANK, FIRST_SPACE, MORE_BLANK, MORE_SPACE, QUOTE, QUOTE_E, QUOTE_L = range(11)
HERE, BEFORE = 1, 2  # a piece begins at this character, at the one before
_COLUMN, _UNKNOWN, _STATES_KEPT, _PIECES_KEPT = 64, 255, 400_000, 500_000


def _opened(kind: int) -> int:
    """The state after a character that begins a piece or follows its blank."""
    if kind in (LETTER, ENDING, OPENING, E, L):
        return WORD
    return {NUMBER: DIGITS, BLANK: FIRST_BLANK, SPACE: FIRST_SPACE, APOSTROPHE: QUOTE, SIGN: SIGNS, ADDED: NEW, DONE: NEW}[kind]


def step(state: int, kind: int) -> tuple[int, int]:
    """Next state and marks of one character."""
    if kind >= FRESH:
        return (_opened(kind - FRESH), HERE | step(state, DONE)[1] & BEFORE)
    if kind == DONE:
        return NEW, HERE | BEFORE * (state in (QUOTE_E, QUOTE_L))
    if kind == ADDED:
        return NEW, 0
    after = _opened(kind)
    if state in (QUOTE, QUOTE_E, QUOTE_L):
        if state == QUOTE:
            if kind == ENDING:
                return NEW, 0
            if kind in (OPENING, L):
                return (QUOTE_L if kind == L else QUOTE_E), 0
            return (SIGNS, 0) if kind in (SIGN, APOSTROPHE) else (after, HERE)
        if kind == (E if state == QUOTE_E else L):
            return NEW, 0
        return after, BEFORE | HERE * (after != WORD)
    if kind in (BLANK, SPACE):
        if state >= FIRST_BLANK:
            return (MORE_BLANK if kind == BLANK else MORE_SPACE), 0
        return after, HERE
    if state in (FIRST_BLANK, MORE_BLANK):  # the blank belongs to what follows
        return (SIGNS if kind == APOSTROPHE else after), BEFORE * (state == MORE_BLANK)
    if state in (FIRST_SPACE, MORE_SPACE):
        return after, HERE | BEFORE * (state == MORE_SPACE)
    if state == SIGNS and kind in (SIGN, APOSTROPHE):
        return SIGNS, 0
    return after, HERE * (after != state)


class Splitter:
    """The first machine: begins of pieces."""

    def __init__(self, split, added: list[str]):
        self.split, self.added = split, re.compile(b"|".join(re.escape(a.encode()) for a in sorted(added, key=len, reverse=True))) if added else None
        self.longest = max((len(a.encode()) for a in added), default=0)
        self.kind = np.full(0x110000, _UNKNOWN, np.uint8)
        for letters, kind in ((ENDS, ENDING), ("rv", OPENING), ("e", E), ("l", L), (" ", BLANK), ("'", APOSTROPHE)):
            for c in letters:
                self.kind[ord(c)] = kind
        kinds, states = 2 * FRESH, range(QUOTE_L + 1)
        moves = [[step(s, k) for k in range(kinds)] for s in states]
        self.marks = np.array([[m for _, m in row] for row in moves], np.uint8)
        maps = {tuple(moves[s][k][0] for s in states): None for k in range(kinds)}
        self.of_kind = np.array([list(maps).index(tuple(moves[s][k][0] for s in states)) for k in range(kinds)])
        first, found = list(maps), list(maps)
        for one in found:  # grows while it is read: all compositions
            for other in first:
                both = tuple(other[s] for s in one)
                if both not in maps:
                    maps[both] = None
                    found.append(both)
        number = {m: k for k, m in enumerate(found)}
        self.apply = np.array(found, np.uint8)
        self.compose = np.array([[number[tuple(b[s] for s in a)] for b in found] for a in found], np.uint16)

    def kinds(self, codes: np.ndarray) -> np.ndarray:
        """Kinds of characters; new ones are tried beside a letter, a number and a sign."""
        out = self.kind[codes]
        if (out == _UNKNOWN).any():
            for c in np.unique(codes[out == _UNKNOWN]).tolist():
                one = lambda a: len(self.split(a + chr(c) + a)) == 1  # noqa: E731, B023
                self.kind[c] = LETTER if one("a") else NUMBER if one("1") else SIGN if one("!") else SPACE
            out = self.kind[codes]
        return out

    def before(self, kinds: np.ndarray, start: int = NEW) -> np.ndarray:
        """The state before each character."""
        n = len(kinds)
        columns = -(-n // _COLUMN)
        grid = np.zeros(columns * _COLUMN, np.intp)
        grid[:n] = kinds
        grid = self.of_kind[np.ascontiguousarray(grid.reshape(columns, _COLUMN).T)]
        maps = np.empty((_COLUMN, columns), np.uint16)
        maps[0] = grid[0]
        for k in range(1, _COLUMN):
            maps[k] = self.compose[maps[k - 1], grid[k]]
        whole, reach = maps[-1].copy(), 1
        while reach < columns:  # after each round a column's map covers twice as many columns up to its own
            whole[reach:] = self.compose[whole[:-reach], whole[reach:]]
            reach *= 2
        begin = np.r_[np.uint8(start), self.apply[whole[:-1], start]]
        after = self.apply[maps, begin].T.ravel()
        return np.r_[np.uint8(start), after[: n - 1]]

    def begins(self, data: bytes, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte places where pieces begin, and which of them are added tokens. `texts`: where the (nonempty) texts in `data` begin."""
        if data.isascii():
            codes, places = np.frombuffer(data, np.uint8), None
        else:
            codes = np.frombuffer(data.decode().encode("utf-32-le"), np.uint32)
            sizes = 1 + (codes > 0x7F).astype(np.int64) + (codes > 0x7FF) + (codes > 0xFFFF)
            places = np.cumsum(sizes) - sizes
        at = (lambda b: b) if places is None else (lambda b: np.searchsorted(places, b))
        kinds = self.kinds(codes).copy()
        heads = at(texts)
        fresh = np.zeros(len(kinds), bool)
        fresh[heads] = True
        extra = []
        for a, b in self.found(data, texts):
            i, j = int(at(a)), int(at(b))
            kinds[i:j] = ADDED
            fresh[i] = True
            if j < len(fresh):
                fresh[j] = True
            extra.append(a)
        kinds[fresh] += FRESH
        states = self.before(kinds)
        marks = self.marks[states, kinds]
        begin = (marks & HERE) > 0
        begin[:-1] |= (marks[1:] & BEFORE) > 0
        last = self.apply[self.of_kind[kinds[-1]], states[-1]]
        begin[-1] |= (self.marks[last, DONE] & BEFORE) > 0
        begin = np.flatnonzero(begin)
        return (begin if places is None else places[begin]), np.array(extra, np.int64)

    def found(self, data: bytes, texts: np.ndarray):
        """Begin and end of each added token; none spans two texts."""
        if self.added is None or not self.added.search(data):
            return
        edges = [*texts.tolist(), len(data)]
        for a, b in pairwise(edges):
            yield from (m.span() for m in self.added.finditer(data, a, b))


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins of bytes in the file's vocabulary: themselves where printable, else the code points from 256 on in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Merges:
    """Which tokens may stand side by side: those between which no merge crosses."""

    def __init__(self, model: dict):
        letters = _byte_letters()
        raw = lambda t: bytes(letters[c] for c in t)
        pairs = [x if isinstance(x, list) else x.split(" ") for x in model["merges"]]
        self.tokens = [bytes([b]) for b in range(256)]
        ids = {t: k for k, t in enumerate(self.tokens)}
        self.rank: dict[tuple[int, int], int] = {}
        self.halves: list[tuple[int, int] | None] = [None] * 256
        for a, b in pairs:
            a, b = ids[raw(a)], ids[raw(b)]
            both = self.tokens[a] + self.tokens[b]
            if both not in ids:
                ids[both] = len(self.tokens)
                self.tokens.append(both)
                self.halves.append((a, b))
            self.rank[a, b] = len(self.rank)
        self.born = [-1] * 256 + [self.rank[h] for h in self.halves[256:]]
        self.memo: dict[tuple[int, int], bool] = {}
        #: Tokens that their own bytes give; the others never come out.
        self.whole = [True] * 256
        for k in range(256, len(self.tokens)):
            a, b = self.halves[k]
            self.whole.append(self.whole[a] and self.whole[b] and self.crossing(a, b) == self.born[k])

    def _edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """What stands at a token's left (0) or right (1) edge while it is merged, each with the rank of the merge that takes it up."""
        out: list[tuple[int, float]] = [(token, float("inf"))]
        while self.halves[token]:
            born = self.born[token]
            token = self.halves[token][side]
            out.append((token, born))
        return out[::-1]

    def crossing(self, left: int, right: int) -> int | None:
        """The rank of the first merge across the border of two tokens, none if they stay apart. Of equal ranks the leftmost goes first."""
        one, other, i, j = self._edge(left, 1), self._edge(right, 0), 0, 0
        while True:
            (x, x_ends), (y, y_ends) = one[i], other[j]
            met = self.rank.get((x, y))
            if met is not None and met < x_ends and met <= y_ends:
                return met
            if i == len(one) - 1 and j == len(other) - 1:
                return None
            i, j = i + (x_ends <= y_ends), j + (y_ends <= x_ends)

    def apart(self, left: int, right: int) -> bool:
        found = self.memo.get((left, right))
        if found is None:
            if len(self.memo) > 2_000_000:
                self.memo.clear()
            found = self.memo[left, right] = self.crossing(left, right) is None
        return found


class Counter:
    """The second machine: tokens of a piece."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.child: dict[int, int] = {}
        self.token: list[int] = [-1]
        inner = [False]
        for k, t in enumerate(merges.tokens):
            if merges.whole[k]:
                node = 0
                for b in t:
                    inner[node] = True
                    below = self.child.setdefault(node << 8 | b, len(self.token))
                    if below == len(self.token):
                        self.token.append(-1)
                        inner.append(False)
                    node = below
                self.token[node] = k
        self.inner = inner
        self.forget()

    def forget(self) -> None:
        """Starts compiling anew, as when too many states were met."""
        #: Of each state: (node, token before, count less the present one) of every place where a token may be under way.
        self.places = [((0, -1, 0),)]
        self.number = {self.places[0]: 0}
        self.next: dict[int, tuple[int, int]] = {}

    def compiled(self, state: int, byte: int) -> tuple[int, int]:
        moved, token, more = [], -1, 0
        for node, before, count in self.places[state]:
            below = self.child.get(node << 8 | byte)
            if below is not None:
                if self.inner[below]:
                    moved.append((below, before, count))
                t = self.token[below]
                if t >= 0 and token < 0 and (before < 0 or self.merges.apart(before, t)):
                    token, more = t, count + 1
        places = (*((n, t, c - more) for n, t, c in moved), (0, token, 0))
        to = self.number.setdefault(places, len(self.places))
        if to == len(self.places):
            self.places.append(places)
        self.next[state << 8 | byte] = found = (to, more)
        return found

    def count(self, piece: bytes) -> int:
        if len(self.places) > _STATES_KEPT:
            self.forget()
        state = total = 0
        known = self.next
        for b in piece:
            found = known.get(state << 8 | b)
            if found is None:
                if len(self.places) > 2 * _STATES_KEPT:  # within a very long piece: only the present state is taken along
                    here = self.places[state]
                    self.forget()
                    known = self.next
                    state = self.number.setdefault(here, len(self.places))
                    if state == len(self.places):
                        self.places.append(here)
                found = self.compiled(state, b)
            state = found[0]
            total += found[1]
        return total


class Machine:
    """Both machines of a tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model, added = spec["pre_tokenizer"] or {}, spec["model"], spec["added_tokens"]
        if (pre.get("type"), pre.get("add_prefix_space"), pre.get("use_regex", True), model["type"], spec["normalizer"]) != ("ByteLevel", False, True, "BPE", None) or model.get("dropout") or model.get("ignore_merges"):
            raise ValueError("only byte-level BPE tokenizers without normalizer are compiled")
        if any(a[k] for a in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens must be plain")
        self.split = Splitter(Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str, [a["content"] for a in added])
        self.counter = Counter(Merges(model))
        self.known: dict[bytes, int] = {}

    def of(self, piece: bytes) -> int:
        found = self.known.get(piece)
        if found is None:
            found = self.counter.count(piece)
            if len(piece) <= 64:
                if len(self.known) > _PIECES_KEPT:
                    self.known.clear()
                self.known[piece] = found
        return found

    def pieces(self, data: bytes, begins: np.ndarray, added: np.ndarray) -> np.ndarray:
        """Tokens of each piece, the last ending with `data`; distinct pieces are looked up once."""
        edges = pa.py_buffer(np.r_[begins, len(data)].astype(np.int32))
        found = pa.Array.from_buffers(pa.binary(), len(begins), [None, edges, pa.py_buffer(data)]).dictionary_encode()
        out = np.array([self.of(p) for p in found.dictionary.to_pylist()], np.int64)[found.indices.to_numpy()]
        out[np.searchsorted(begins, added)] = 1
        return out

    def counts(self, data: bytes, edges: np.ndarray, block: int = 4 << 20) -> np.ndarray:
        """Tokens of each text; `edges` are their ends, after a 0. A text beyond `block` bytes is read in blocks."""
        out = np.zeros(len(edges) - 1, np.int64)
        full = np.flatnonzero(np.diff(edges))
        if not len(full):
            return out
        if len(data) > 2 * block and len(full) == 1:
            out[full[0]] = self.long(data, block)
            return out
        begins, added = self.split.begins(data, edges[full])
        sums = np.r_[0, np.cumsum(self.pieces(data, begins, added))]
        at = np.searchsorted(begins, edges)
        return sums[at[1:]] - sums[at[:-1]]

    def long(self, data: bytes, block: int) -> int:
        """Tokens of one text, block by block: each ends at the last begin of a piece that nothing further on can move."""
        total, at, size = 0, 0, block
        while at < len(data):
            end = at + size
            while end < len(data) and data[end] & 0xC0 == 0x80:
                end += 1
            part = data[at:end]
            begins, added = self.split.begins(part, np.zeros(1, np.int64))
            counted = part
            if end < len(data):
                sure = int(begins[np.searchsorted(begins, len(part) - self.split.longest - 16, "right") - 1])
                if sure == 0:  # one piece beyond a block
                    size *= 2
                    continue
                begins, added, counted = begins[begins < sure], added[added < sure], part[:sure]
            total += int(self.pieces(counted, begins, added).sum())
            at, size = at + len(counted), block
        return total


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _run(path: str | None):
    def run(batches):
        kept = KEPT.setdefault("token_counts", {})
        machine = kept.get(path) or kept.setdefault(path, Machine(path or tokenizer_path("byte_bpe_50k.json")))
        for batch in batches:
            for part in chunks(batch, "text"):
                texts = pc.fill_null(column(part, "text").cast(pa.binary()), b"")
                edges = np.r_[0, np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))]
                data = b"".join(texts.to_pylist())
                found = machine.counts(data, edges)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.diff(edges)), pa.array(found)], names=[*part.schema.names, "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """Every row of `docs` with n_bytes (UTF-8) and n_tokens, the length of the tokenizer library's own encoding of the whole text.

    `tokenizer`: path of a byte-level BPE file of the tokenizers library; None is the public byte_bpe_50k.json of the worker. Null and
    empty texts have no bytes and no tokens. Repeated rows, null ids and other columns stay as they are; input columns named n_bytes or
    n_tokens are replaced. Rows are counted one by one, texts of any length in blocks; nothing is shuffled. A worker keeps at
    most 500,000 pieces and 800,000 states, then starts anew.
    """
    docs = without(docs, "n_bytes", "n_tokens")
    return mapped(docs, {"text": text_col}, lean(_run(tokenizer), "token_counts"), n_bytes=T.LongType(), n_tokens=T.LongType())


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))
