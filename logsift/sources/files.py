"""Lines of log files with byte offsets as numbers: one data source for tables and streams.

`line_no` is the offset of the line's first byte, so it does not depend on how files
are split, grows along the file, and needs no counting pass. Bytes are handed on as
they are, also where they are no UTF-8. Lines end at newline only.

A table (`read_lines`) has the lines of all files, cut into splits of `split_bytes`; a
line belongs to the split it begins in, and splits of small files share a task. The log is
the file.

A stream (`stream_text`) polls the paths. Only whole lines are taken: what follows
the last newline waits. A log is a file's path and a hash of its first line, joined by
"#". If the file at a path is replaced (rotated), the first line is another one and so
is the log; the rest of the old one is read from a renamed copy whose name begins with
the old name and a dot (`app.log.1`). Generations of one path must differ in their first
line, as those with a process id or a time do; if two files of one path begin with the
same line, that is an error. Offsets hold a position per log, so a restarted query goes
on where it was.

If a folder is named for them (`positions`), the positions are written there and an offset
only says where, by a digest of what they are; what each task reads is written beside
them. The driver then holds neither: files are listed, sorted, looked into and compared
with the last positions as streams. Without it they are in the offsets themselves, of which
Spark keeps several in memory, so that is for some thousand logs.

Files are opened through Arrow's file systems, on the driver (listing, the ends of
lines) and in tasks. Nothing listens on a port here; Spark runs the driver's part of a
Python stream source in a Python worker like those of any Python function.
"""

from __future__ import annotations

import fnmatch
import hashlib
import heapq
import json
import os
import pickle
import posixpath
import tempfile
from collections.abc import Iterable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from itertools import batched, islice
from typing import IO

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "log_id string, line_no long, value string"
NAME = "logsift_lines"
SPLIT_BYTES = 64 << 20
#: Bytes that could be read while a file is opened: files that are small share a partition by it.
OPEN_BYTES = 256 << 10
#: Files that the driver opens at a time to look for their ends.
OPENED = 16
#: Files that it looks into, or positions that it writes, one after the other.
LOOKED = 1 << 11
#: Names or positions that it sorts at a time, and temporary files of so many that it merges at a time.
HELD = 1 << 15
MERGED = 64
#: Bytes read at a time; a longer line is read whole.
BLOCK = 8 << 20
#: Bytes read first where the end of a line is looked for.
HEAD = 64 << 10
_ARROW = pa.schema([("log_id", pa.string()), ("line_no", pa.int64()), ("value", pa.string())])
_POSITIONS = pa.schema([("log", pa.string()), ("file", pa.string()), ("end", pa.int64())])
_PLAN = pa.schema([(n, pa.string()) for n in ("log_id", "file")] + [(n, pa.int64()) for n in ("begin", "end", "stop")])
_PACKED = pa.ipc.IpcWriteOptions(compression="zstd")
#: An offset with this key alone says where its positions are.
_PLACE = "positions"
#: What a file is called until it is whole; one at a time.
_WRITING = "writing"
_GLOB = "*?["


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _prefix(path: str, inner: str) -> str:
    """What stands before the file system's own path in a path."""
    return path[: len(path) - len(inner)] if path.endswith(inner) else ""


def _copy_of(path: str, names: set[str]) -> str | None:
    """The shortest of the names that the path continues with a dot and more."""
    dot = path.find(".")
    while dot >= 0:
        if path[:dot] in names:
            return path[:dot]
        dot = path.find(".", dot + 1)
    return None


def _spilled(rows: Iterable[tuple]) -> Iterator[tuple]:
    """The rows by way of a temporary file."""
    file = tempfile.TemporaryFile()
    for row in rows:
        pickle.dump(row, file)
    file.seek(0)

    def read(file: IO[bytes]) -> Iterator[tuple]:
        with file:
            while file.peek(1):
                yield pickle.load(file)

    return read(file)


def _sorted(rows: Iterable[tuple]) -> Iterator[tuple]:
    """The rows in order; if they are many, all but the last of them wait in files."""
    rows, runs = iter(rows), []
    while held := sorted(islice(rows, HELD)):
        if len(held) < HELD:
            return heapq.merge(*runs, held)
        runs.append(_spilled(held))
        if len(runs) == MERGED:
            runs = [_spilled(heapq.merge(*runs))]
    return heapq.merge(*runs)


def _in_folder(system: fs.FileSystem, folder: str, may_miss: bool = False) -> Iterator[tuple[str, int]]:
    """Path and size of the files in a folder; those of a local one are not held all at once."""
    if not isinstance(system, fs.LocalFileSystem):
        for info in system.get_file_info(fs.FileSelector(folder, allow_not_found=may_miss)):
            if info.type == fs.FileType.File:
                yield info.path, info.size
        return
    try:
        entries = os.scandir(folder)
    except FileNotFoundError:
        if may_miss:
            return
        raise
    with entries:
        for entry in entries:
            try:
                if entry.is_file():
                    yield f"{folder.rstrip('/')}/{entry.name}", entry.stat().st_size
            except FileNotFoundError:
                continue  # gone since the folder was read


def _listed(path: str, copies: bool) -> Iterator[tuple[str, bool, int]]:
    """File, if it is none that was asked for, size: of a path's files, and with `copies` of all files beside them."""
    system, inner = _opened(path)
    before = _prefix(path, inner)
    folder, pattern = posixpath.split(inner.rstrip("/"))
    if any(c in pattern for c in _GLOB):
        listed = _in_folder(system, folder, may_miss=True)
    else:
        [info] = system.get_file_info([inner])
        if info.type == fs.FileType.File:
            yield before + info.path, info.base_name.startswith((".", "_")), info.size
            pattern, listed = "", _in_folder(system, posixpath.dirname(inner)) if copies else ()
        else:
            pattern, listed = "*", _in_folder(system, inner) if info.type == fs.FileType.Directory else ()
    for file, size in listed:
        name = posixpath.basename(file)
        other = name.startswith((".", "_")) or not fnmatch.fnmatchcase(name, pattern)
        if copies or not other:
            yield before + file, other, size


def list_files(paths: Sequence[str], copies: bool = False) -> Iterator[tuple[str, str, int]]:
    """Path that was asked for, actual file, size: of files, files of folders, and globs in the last part.

    With `copies`, also the files named like a found one with a dot and more.
    """
    # With dots before all other letters, what continues a name with a dot comes right after it.
    rows = ((f.replace(".", "\0"), n, other, size) for n, p in enumerate(paths) for f, other, size in _listed(p, copies))
    owners: dict[int, str] = {}
    last = None
    for key, n, other, size in _sorted(rows):
        file = key.replace("\0", ".")
        # A copy that the paths match as well belongs to the file it is a copy of.
        asked = _copy_of(file, {owners.get(n)}) if copies else None
        if asked is None:
            if other:
                continue
            owners[n] = asked = file
        if last and last[1] != file:
            yield last
        # A file that several paths have belongs to the last of them.
        last = asked, file, size
    if last:
        yield last


class Range(InputPartition):
    """The lines that begin in a part of a file."""

    def __init__(self, log_id: str, file: str, begin: int, end: int, stop: int) -> None:
        #: Lines begin from begin to end; nothing is read from stop on.
        self.log_id, self.file, self.begin, self.end, self.stop = log_id, file, begin, end, stop


def ranges(log_id: str, file: str, begin: int, stop: int, split_bytes: int) -> list[Range]:
    """Parts of a file from a line's begin on."""
    cuts = [*range(begin, stop, split_bytes), stop]
    return [Range(log_id, file, a, b, stop) for a, b in zip(cuts, cuts[1:], strict=False)]


class Ranges(InputPartition):
    """Ranges that one task reads after each other."""

    def __init__(self, parts: list[Range]) -> None:
        self.parts = parts

    def read(self) -> Iterator[pa.RecordBatch]:
        for part in self.parts:
            yield from read_range(part)


def packed(parts: Iterable[Range], split_bytes: int) -> Iterator[Ranges]:
    """Neighbouring ranges in one partition, up to a split's bytes with what opening each file counts as."""
    held: list[Range] = []
    room = 0
    for part in parts:
        cost = part.end - part.begin + OPEN_BYTES
        if held and cost > room:
            yield Ranges(held)
            held = []
        if not held:
            room = split_bytes
        held.append(part)
        room -= cost
    if held:
        yield Ranges(held)


class Planned(InputPartition):
    """Ranges that are written as a record batch of a file."""

    def __init__(self, plan: str, place: int) -> None:
        self.plan, self.place = plan, place

    def read(self) -> Iterator[pa.RecordBatch]:
        system, inner = _opened(self.plan)
        with system.open_input_file(inner) as source:
            rows = pa.ipc.open_file(source).get_batch(self.place).to_pylist()
        yield from Ranges([Range(**r) for r in rows]).read()


def _rows(log_id: str, at: int, held: bytes) -> pa.RecordBatch:
    """Rows of whole lines; the last newline may be missing."""
    if not held.endswith(b"\n"):
        held += b"\n"
    flat = np.frombuffer(held, np.uint8)
    ends = np.flatnonzero(flat == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    text = pa.py_buffer(flat[flat != 10].tobytes())
    value = pa.StringArray.from_buffers(len(ends), pa.py_buffer(offsets), text)
    log = pa.DictionaryArray.from_arrays(np.zeros(len(ends), np.int32), [log_id]).cast(pa.string())
    return pa.RecordBatch.from_arrays([log, pa.array(at + starts), value], schema=_ARROW)


def read_range(part: Range, block: int = BLOCK) -> Iterator[pa.RecordBatch]:
    system, inner = _opened(part.file)
    with system.open_input_file(inner) as source:
        # The byte before tells whether a line begins right here.
        at = max(part.begin - 1, 0)
        source.seek(at)
        held, searching = b"", part.begin > 0
        while True:
            more = source.read(min(block, part.stop - at - len(held)))
            held += more
            if searching:
                newline = held.find(b"\n")
                if newline < 0:
                    at, held = at + len(held), b""
                else:
                    at, held, searching = at + newline + 1, held[newline + 1 :], False
            if not searching and at < part.end:
                last = held.rfind(b"\n") + 1 if more else len(held)
                # The last line of this part is the one that reaches its end.
                if at + last > part.end:
                    newline = held.find(b"\n", part.end - 1 - at)
                    last = newline + 1 if newline >= 0 else (0 if more else len(held))
                if last:
                    yield _rows(part.log_id, at, held[:last])
                    at, held = at + last, held[last:]
            if not more or (not searching and at >= part.end):
                return


def _last_newline(source: pa.NativeFile, size: int) -> int:
    """The offset behind the last newline of a file's first bytes, 0 if there is none."""
    stop = min(size, source.size())
    while stop > 0:
        # A little first: the last line is seldom long.
        begin = max(0, stop - (BLOCK if stop < size else HEAD))
        source.seek(begin)
        newline = source.read(stop - begin).rfind(b"\n")
        if newline >= 0:
            return begin + newline + 1
        stop = begin
    return 0


def _first_line_hash(source: pa.NativeFile) -> str:
    digest = hashlib.sha256()
    source.seek(0)
    while piece := source.read(HEAD):
        line, newline, _ = piece.partition(b"\n")
        digest.update(line)
        if newline:
            break
    return digest.hexdigest()[:12]


def whole_lines(file: str, size: int) -> tuple[int, str]:
    """Where the whole lines of a file's first bytes end (0 if there are none), and a hash of the first."""
    system, inner = _opened(file)
    with system.open_input_file(inner) as source:
        end = _last_newline(source, size)
        return end, _first_line_hash(source) if end else ""


class _Table(DataSourceReader):
    def __init__(self, paths: list[str], split_bytes: int) -> None:
        self.paths, self.split_bytes = paths, split_bytes

    def partitions(self) -> Sequence[InputPartition]:
        found = [r for _, file, size in sorted(list_files(self.paths)) for r in ranges(file, file, 0, size, self.split_bytes)]
        return list(packed(found, self.split_bytes)) or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        yield from partition.read()


def _found_logs(paths: Sequence[str]) -> Iterator[tuple[str, str, int]]:
    """Log, its file and the end of its whole lines, in the order of the logs."""

    def looked() -> Iterator[tuple[str, str, int]]:
        with ThreadPoolExecutor(OPENED) as pool:
            for listed in batched(list_files(paths, copies=True), LOOKED):
                ends = pool.map(lambda found: whole_lines(found[1], found[2]), listed, chunksize=64)
                for (asked, file, _), (end, first) in zip(listed, ends, strict=True):
                    if end:
                        yield f"{asked}#{first}", file, end

    before = None
    for row in _sorted(looked()):
        if before and before[0] == row[0]:
            raise ValueError(f"{row[1]} and {before[1]} begin with the same line")
        yield (before := row)


def _where(offset: dict) -> str | None:
    """Where the positions of an offset are written, if they are not in it."""
    place = offset.get(_PLACE)
    return place if isinstance(place, str) else None


def _positions(offset: dict) -> Iterator[tuple[str, str, int]]:
    """Log, file and end of an offset's logs, in the order of the logs."""
    if (place := _where(offset)) is None:
        for log, at in sorted(offset.items()):
            yield log, at["file"], at["end"]
        return
    system, inner = _opened(place)
    with system.open_input_stream(inner) as source:
        for batch in pa.ipc.open_stream(source):
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _new_ranges(start: dict, end: dict, split_bytes: int) -> Iterator[Range]:
    """What an offset has beyond another one."""
    before = _positions(start)
    old = next(before, None)
    for log, file, stop in _positions(end):
        while old and old[0] < log:
            old = next(before, None)
        begin = old[2] if old and old[0] == log else 0
        if begin < stop:
            yield from ranges(log, file, begin, stop, split_bytes)


class _Stream(DataSourceStreamReader):
    """Offsets: log -> its file and the end of its whole lines, or where that is written."""

    def __init__(self, paths: list[str], split_bytes: int, positions: str = "") -> None:
        self.paths, self.split_bytes, self.positions = paths, split_bytes, positions.rstrip("/")
        #: The offset handed out last.
        self.latest: dict | None = None

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        found = _found_logs(self.paths)
        if not self.positions:
            return {log: {"file": file, "end": end} for log, file, end in found}
        system, folder = _opened(self.positions)
        system.create_dir(folder, recursive=True)
        # The name is the digest of what is in it: nothing new, the same offset, also after a restart.
        digest, count, writing = hashlib.sha256(), 0, f"{folder}/{_WRITING}"
        with system.open_output_stream(writing) as sink, pa.ipc.new_stream(sink, _POSITIONS, options=_PACKED) as out:
            for rows in batched(found, LOOKED):
                digest.update("".join(f"{log}\0{file}\0{end}\0" for log, file, end in rows).encode())
                out.write_batch(pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], schema=_POSITIONS))
                count += len(rows)
        name = f"{digest.hexdigest()}.positions"
        system.move(writing, f"{folder}/{name}")
        self.latest = {_PLACE: f"{self.positions}/{name}"} if count else {}
        return self.latest

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        parts = packed(_new_ranges(start, end, self.split_bytes), self.split_bytes)
        if (place := _where(end)) is None:
            return list(parts)
        name = hashlib.sha256(json.dumps([start, end], sort_keys=True).encode()).hexdigest()
        plan = f"{posixpath.dirname(place)}/{name}.plan"
        system, inner = _opened(plan)
        count, writing = 0, f"{posixpath.dirname(inner)}/{_WRITING}"
        with system.open_output_stream(writing) as sink, pa.ipc.new_file(sink, _PLAN, options=_PACKED) as out:
            for count, part in enumerate(parts, 1):
                out.write_batch(pa.RecordBatch.from_pylist([vars(r) for r in part.parts], schema=_PLAN))
        system.move(writing, inner)
        return [Planned(plan, n) for n in range(count)]

    def read(self, partition: Ranges | Planned) -> Iterator[pa.RecordBatch]:
        yield from partition.read()

    def commit(self, end: dict) -> None:
        """Forget positions from before an offset; a restart needs that one and the one after, the last handed out."""
        if not self.positions or self.latest is None:
            return
        needed = {posixpath.basename(_where(offset) or "") for offset in (end, self.latest)}
        system, folder = _opened(self.positions)
        for file, _ in list(_in_folder(system, folder)):
            name = posixpath.basename(file)
            if name.endswith((".positions", ".plan")) and name not in needed:
                system.delete_file(file)


class LineSource(DataSource):
    """Format `logsift_lines`; options: paths (one a line), split_bytes, positions (a folder, for streams)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def _options(self) -> tuple[list[str], int]:
        paths = [p for p in self.options["paths"].split("\n") if p]
        return paths, int(self.options.get("split_bytes", SPLIT_BYTES))

    def reader(self, schema) -> DataSourceReader:
        return _Table(*self._options())

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(*self._options(), self.options.get("positions", ""))


def _paths(paths: str | Sequence[str]) -> str:
    return paths if isinstance(paths, str) else "\n".join(paths)


def read_lines(spark: SparkSession, paths: str | Sequence[str], split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """log_id (the file), line_no (byte offset), value: the lines of text files."""
    spark.dataSource.register(LineSource)
    return spark.read.format(NAME).option("paths", _paths(paths)).option("split_bytes", split_bytes).load()


def stream_text(
    spark: SparkSession, paths: str | Sequence[str], split_bytes: int = SPLIT_BYTES, positions: str | None = None
) -> DataFrame:
    """The same as a stream that follows the files as they grow and are rotated.

    `positions` is a folder that driver and tasks share, for one query alone and to be kept like
    its checkpoint; name one if the logs are more than some thousand.
    """
    spark.dataSource.register(LineSource)
    reader = spark.readStream.format(NAME).option("paths", _paths(paths)).option("split_bytes", split_bytes)
    return (reader.option("positions", positions) if positions else reader).load()
