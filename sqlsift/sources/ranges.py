"""Log files as a data source that is split: byte ranges of any size, each giving the entries that begin in it.

A range looks for the first line at or behind its start that begins an entry, and reads its last entry past its end. So every entry
comes from exactly one range, wherever ranges are cut, also inside an entry or a letter. A reader holds one entry and
one piece of the file. Small files share a task; packed files (.gz, .bz2, .zst) are one range each.

The same source streams: its offset is the place in each file up to which entries were taken. The last entry of a file waits
until another begins behind it or the file has not changed for `settleSeconds`.

Options: path (a file or folder), rangeBytes (64 MB), settleSeconds (60), files (a JSON list of the names to read, all by default).
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Where an entry begins: a line with a date, a time and a zone. Python and Java read it alike (`d`: only \n ends a line for Java).
BEGIN = r"^[ \t]*(?=\d+-\d+-\d+ +\d+:\d+:\d+(?:\.\d+)? +(?:\w+|[+-]\d[\d:]*):)"
_BEGIN = re.compile(rb"(?m)" + BEGIN.encode())
_PIECE = 1 << 20
_PACKED = (".gz", ".bz2", ".zst")
SCHEMA = "file string, entry_no long, entry string"


@dataclass
class Part:
    """The entries of a file that begin in [start, end)."""

    file: str
    start: int
    end: int
    exact: bool  # an entry begins at start, or what stands there is to be one
    limit: int | None = None  # nothing behind it is read


class Ranges(InputPartition):
    """What one task reads."""

    def __init__(self, parts: list[Part]):
        super().__init__(None)
        self.parts = parts


def _opened(path: str):
    """The file system of a path, and the path there."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def listed(path: str) -> list[tuple[str, int, float]]:
    """Name, size and time of the last change of each log file at a path, by name; hidden files are none."""
    from pyarrow import fs

    system, inner = _opened(path)
    head = path[: len(path) - len(inner)] if path.endswith(inner) and "://" in path else ""
    info = system.get_file_info(inner)
    found = system.get_file_info(fs.FileSelector(inner, recursive=True)) if info.type == fs.FileType.Directory else [info]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    return sorted((head + f.path, f.size, f.mtime.timestamp() if f.mtime else 0.0) for f in found if f.type == fs.FileType.File and f.base_name[0] not in "._")


def _pieces(stream) -> Iterator[tuple[bytes, bool]]:
    """Whole lines, about a piece at a time, and whether they are the last."""
    held: list[bytes] = []
    while piece := stream.read(_PIECE):
        cut = piece.rfind(b"\n") + 1
        if cut:
            yield b"".join([*held, piece[:cut]]), False
            held = []
        held.append(piece[cut:])
    yield b"".join(held), True


class _Limited:
    """A stream that ends at a place."""

    def __init__(self, stream, left: int):
        self.stream, self.left = stream, left

    def read(self, n: int) -> bytes:
        found = self.stream.read(min(n, self.left)) if self.left > 0 else b""
        self.left -= len(found)
        return found


def first_read(start: int, exact: bool) -> int:
    """Where to read from: a byte before, to see whether a line begins at `start`."""
    return start if exact else start - 1


def entries_of(stream, start: int, end: int, exact: bool, limit: int | None = None) -> Iterator[tuple[int, bytes]]:
    """Place and text of the entries that begin in [start, end), `stream` being at `first_read`. With `exact`, what stands before the first is one, too."""
    at = first_read(start, exact)
    lines = _pieces(stream if limit is None else _Limited(stream, limit - at))
    begun, parts = (start if exact else None), []
    skip = not exact  # up to the first line that begins at `start` or behind
    for piece, last in lines:
        if skip:
            cut = piece.find(b"\n") + 1
            if not cut:
                return
            piece, at, skip = piece[cut:], at + cut, False
        done = 0
        for m in _BEGIN.finditer(piece):
            if begun is not None:
                parts.append(piece[done : m.start()])
                if text := b"".join(parts):
                    yield begun, text
            if at + m.start() >= end:
                return
            begun, parts, done = at + m.start(), [], m.end()
        if begun is not None:
            parts.append(piece[done:])
        at += len(piece)
        if begun is None and at >= end:
            return
        if last and begun is not None and (text := b"".join(parts)):
            yield begun, text


def _read(ranges: Ranges):
    import pyarrow as pa

    names, places, texts, size = [], [], [], 0

    def taken():
        found = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(places, pa.int64()), pa.array(texts, pa.string())], names=["file", "entry_no", "entry"])
        names.clear(), places.clear(), texts.clear()
        return found

    for p in ranges.parts:
        system, inner = _opened(p.file)
        with system.open_input_stream(inner) if p.file.endswith(_PACKED) else system.open_input_file(inner) as stream:
            if p.start:
                stream.seek(first_read(p.start, p.exact))
            for place, text in entries_of(stream, p.start, p.end, p.exact, p.limit):
                names.append(p.file), places.append(place), texts.append(text.decode("utf-8", "replace"))
                size += len(text) + 64
                if size > 4 << 20:
                    yield taken()
                    size = 0
    if names:
        yield taken()


def _planned(parts: Iterator[Part], each: int) -> list[Ranges]:
    """Parts cut into ranges of up to `each` bytes, in tasks of about as many."""
    tasks: list[Ranges] = []
    left = 0
    for p in parts:
        start = p.start
        while start < p.end:
            packed = p.file.endswith(_PACKED)
            stop = p.end if packed else min(p.end, start + each)
            if left < stop - start or not tasks:
                tasks.append(Ranges([]))
                left = each
            tasks[-1].parts.append(Part(p.file, start, 1 << 62, True) if packed else Part(p.file, start, stop, p.exact and start == p.start, p.limit))
            left -= stop - start
            start = stop
    return tasks or [Ranges([])]


class _Batch(DataSourceReader):
    def __init__(self, path: str, each: int, files: str | None):
        self.path, self.each, self.files = path, each, None if files is None else set(json.loads(files))

    def partitions(self):
        return _planned((Part(name, 0, size, True) for name, size, _ in listed(self.path) if self.files is None or name in self.files), self.each)

    def read(self, partition):
        return _read(partition)


def last_begin(name: str, start: int, size: int) -> int:
    """Where the last entry begins that [start, size) of a file holds, `start` if none does; looks from the end on."""
    system, inner = _opened(name)
    with system.open_input_file(inner) as stream:
        reach = _PIECE
        while True:
            low = max(start, size - reach)
            stream.seek(max(0, low - 1))
            piece = stream.read(size - max(0, low - 1))
            cut = piece.find(b"\n") + 1 if low else 0
            whole = piece[cut : piece.rfind(b"\n") + 1] if cut or not low else b""
            begins = [m.start() for m in _BEGIN.finditer(whole)]
            if begins:
                return max(0, low - 1) + cut + begins[-1]
            if low == start:
                return start
            reach *= 4


class _Stream(DataSourceStreamReader):
    def __init__(self, path: str, each: int, settle: float):
        self.path, self.each, self.settle, self.seen = path, each, settle, {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        for name, size, changed in listed(self.path):
            start = self.seen.get(name, 0)
            if size > start:
                settled = time.time() - changed >= self.settle
                if settled or not name.endswith(_PACKED):
                    self.seen[name] = size if settled else last_begin(name, start, size)
        return dict(self.seen)

    def partitions(self, start: dict, end: dict):
        self.seen = {**end, **self.seen}
        return _planned((Part(name, start.get(name, 0), stop, True, stop) for name, stop in sorted(end.items())), self.each)

    def commit(self, end: dict) -> None:
        pass

    def read(self, partition):
        return _read(partition)


class LogSource(DataSource):
    """file, entry_no (the byte at which it begins) and entry of log files."""

    @classmethod
    def name(cls) -> str:
        return "server_logs"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Batch:
        return _Batch(self.options["path"], int(self.options.get("rangebytes", 64 << 20)), self.options.get("files"))

    def streamReader(self, schema) -> _Stream:
        return _Stream(self.options["path"], int(self.options.get("rangebytes", 64 << 20)), float(self.options.get("settleseconds", 60)))
