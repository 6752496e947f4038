"""A data source of payload archives: files of JSON lines that scans append to, split by bytes, read at once or followed
by a stream while they grow."""

from __future__ import annotations

import gzip
import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

FORMAT = "payloads"
SCHEMA = "feed string, source_id long, url string, body string"
ARROW = pa.schema([("feed", pa.string()), ("source_id", pa.int64()), ("url", pa.string()), ("body", pa.string())])
#: Bytes of a file that a task reads; of one read; of the bodies in one batch of rows.
SPLIT, CHUNK, BATCH = 64 << 20, 4 << 20, 8 << 20
STEP = 64 << 10
MOST = (1 << 63) - 1


def file_system(path: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow.fs import FileSystem, LocalFileSystem

    return FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (LocalFileSystem(), path)


@dataclass(frozen=True)
class Range:
    """The lines of a file that end in [start, end); of a packed file, all."""

    name: str
    start: int
    end: int
    last: bool  # whether an unended line at the end counts


@dataclass
class Part(InputPartition):
    """What a task reads."""

    ranges: list[Range]


def sizes(path: str) -> dict[str, int]:
    """Files of a folder at any depth, or one file, and their bytes; names that begin with "." or "_" don't count."""
    from pyarrow.fs import FileSelector, FileType

    fs, root = file_system(path)
    info = fs.get_file_info(root)
    if info.type == FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == FileType.File:
        return {"": info.size}
    base = root.rstrip("/") + "/"
    found = {f.path[len(base) :]: f.size for f in fs.get_file_info(FileSelector(root, recursive=True)) if f.type == FileType.File}
    return {k: n for k, n in found.items() if not any(x[:1] in (".", "_") for x in k.split("/"))}


def line_start(file, place: int) -> int:
    """Where the line begins that goes on at a place: after the last line's end before it."""
    while place > 0:
        at = max(0, place - STEP)
        file.seek(at)
        found = file.read(place - at).rfind(b"\n")
        if found >= 0:
            return at + found + 1
        place = at
    return 0


def lines_of(file, start: int, end: int, last: bool) -> Iterator[bytes]:
    """Lines that end in [start, end), each whole, wherever it begins: ranges that meet give each line once, whatever
    their borders, and what they give doesn't change as the file grows."""
    file.seek(start)
    at, held, first = start, [], True
    while at < end:
        chunk = file.read(min(CHUNK, end - at))
        if not chunk:
            raise OSError("an archive is shorter than it was")
        *ended, rest = chunk.split(b"\n")
        at += len(chunk)
        for x in ended:
            if first:
                begin, first = line_start(file, start), False
                if begin < start:
                    file.seek(begin)
                    held.insert(0, file.read(start - begin))
                file.seek(at)
            yield b"".join((*held, x))
            held = []
        held.append(rest)
    if last:
        begin = line_start(file, start) if first else start
        if begin < start:
            file.seek(begin)
            held.insert(0, file.read(start - begin))
        yield b"".join(held)


def payload(line: bytes, feed: str | None) -> tuple | None:
    """feed, source_id, url and body of a line; None for another feed's and for what is no payload."""
    try:
        x = json.loads(line)
    except ValueError:
        return None
    if not isinstance(x, dict) or not isinstance(x.get("body"), str) or (feed is not None and x.get("feed") != feed):
        return None
    key, source, url = x.get("feed"), x.get("source_id"), x.get("url")
    source = source if type(source) is int and -MOST - 1 <= source <= MOST else None
    row = (key if isinstance(key, str) else None, source, url if isinstance(url, str) else None, x["body"])
    # lone surrogates have no UTF-8
    return tuple(v.encode("utf-8", "replace").decode() if isinstance(v, str) else v for v in row)


def read_ranges(path: str, ranges: list[Range], feed: str | None) -> Iterator[pa.RecordBatch]:
    rows, held = [], 0
    for line in (x for r in ranges for x in read_range(path, r)):
        if (row := payload(line, feed)) is None:
            continue
        rows.append(row)
        held += len(row[3])
        if held >= BATCH:
            yield table(rows)
            rows, held = [], 0
    if rows:
        yield table(rows)


def read_range(path: str, part: Range) -> Iterator[bytes]:
    fs, root = file_system(path)
    name = f"{root.rstrip('/')}/{part.name}" if part.name else root
    if name.endswith(".gz"):
        with fs.open_input_stream(name, compression=None) as file:
            yield from gzip.GzipFile(fileobj=file)
    else:
        with fs.open_input_file(name) as file:
            yield from lines_of(file, part.start, part.end, part.last)


def table(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), ARROW.types)], schema=ARROW)


def ranges_of(name: str, start: int, end: int, split: int, last: bool) -> list[Range]:
    """A file's new bytes in ranges of at most so many; a packed file, whole."""
    if name.endswith(".gz"):
        return [Range(name, 0, end, True)]
    borders = [*range(start, end, split), end]
    return [Range(name, a, b, last and b == end) for a, b in zip(borders, borders[1:])]


def tasks(ranges: Iterable[Range], split: int) -> list[Part]:
    """Ranges in order, small ones together up to so many bytes a task; one task at least, as Spark asks for one."""
    out, held = [Part([])], 0
    for r in ranges:
        size = r.end - r.start
        if out[-1].ranges and held + size > split:
            out.append(Part([]))
            held = 0
        out[-1].ranges.append(r)
        held += size
    return out


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, feed: str | None, split: int):
        self.path, self.feed, self.split = path, feed, split

    def partitions(self) -> list[Part]:
        return tasks((r for k, n in sorted(sizes(self.path).items()) for r in ranges_of(k, 0, n, self.split, True)), self.split)

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return read_ranges(self.path, partition.ranges, self.feed)


class ArchiveStream(DataSourceStreamReader):
    """Offsets are the bytes of each file read so far. A batch is what has been appended since, in any file, old or new;
    a line that isn't ended yet comes with the batch that ends it. What a batch reads depends on its offsets alone."""

    def __init__(self, path: str, feed: str | None, split: int):
        self.path, self.feed, self.split = path, feed, split

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return dict(sorted(sizes(self.path).items()))

    def partitions(self, start: dict, end: dict) -> list[Part]:
        out = []
        for name, size in end.items():
            before = start.get(name, 0)
            if size < before or (name.endswith(".gz") and 0 < before < size):
                raise ValueError(f"{name} was written anew; archives only grow, packed ones stay as they are")
            if size > before:
                out += ranges_of(name, before, size, self.split, False)
        return tasks(out, self.split)

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return read_ranges(self.path, partition.ranges, self.feed)


class Payloads(DataSource):
    """Columns feed, source_id, url, body. Options: path (a file or a folder of files, on a file system that driver and
    executors share), feed (only this feed's payloads), splitbytes (bytes of a file for one task, 64 MiB).

    A line is a JSON object with these columns; lines that aren't, or have no text as body, have no row, and a source_id
    that is no 64-bit integer is null. A line is held whole, a task holds a batch of about 8 MiB. Files that end in .gz
    are read whole by one task, and a stream takes them once, so they are to be moved there when complete; all others
    are split at any byte, and small ones share a task. A file that is taken away is no error for a stream (if it comes
    back it is new), one that got shorter is. The offsets of a stream name each file: one a day or so, not one a
    payload."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def _settings(self) -> tuple[str, str | None, int]:
        split = int(self.options.get("splitbytes", SPLIT))
        if split < 1:
            raise ValueError("splitbytes must be positive")
        return self.options["path"], self.options.get("feed"), split

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(*self._settings())

    def streamReader(self, schema) -> ArchiveStream:
        return ArchiveStream(*self._settings())
