"""A data source of lines that meters append to files: batch and stream.

`spark.dataSource.register(MeterLines)`, then `spark.read` or `spark.readStream`, `.format("meter_lines").load(folder)`: rows (file, at, line), where
`at` is the byte that a line begins with. A line ends with its line feed (a carriage return before it goes); what has none yet is no line, and is
read as a whole once the rest is there. Blank lines are left out. Bytes that are no UTF-8 become replacement characters.

The stream's offset is, for each file, the byte behind the last line feed seen, so a restart from a checkpoint reads on there, and each line is given
once. Files may grow and new ones may come; those that end in `suffix` count, and those that begin with a dot or an underscore do not. Large files
are read in parts of `part_bytes`, each of which gives the lines that begin in it. Folders are local or in a store that Arrow opens by its address.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Bytes of a part, and of a look for a line feed.
PART, LOOK = 32 << 20, 1 << 16
#: Lines of an Arrow batch.
LINES = 8192


@dataclass
class Part(InputPartition):
    """Bytes of a file; lines that begin in [start, end) and end before `known` are this part's."""

    file: str
    start: int
    end: int
    known: int


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def sizes(path: str, suffix: str) -> dict[str, int]:
    """The files of a folder and their bytes now."""
    store, folder = _opened(path)
    found = store.get_file_info(fs.FileSelector(folder, recursive=True))
    hidden = lambda f: any(p[:1] in "._" for p in f.path[len(folder) :].strip("/").split("/"))
    return {f.path: f.size for f in found if f.type == fs.FileType.File and f.path.endswith(suffix) and not hidden(f)}


def whole_lines(path: str, file: str, start: int, size: int) -> int:
    """The byte behind the last line feed in [start, size), or start: found from the end."""
    store, _ = _opened(path)
    with store.open_input_file(file) as f:
        end = size
        while end > start:
            begin = max(start, end - LOOK)
            at = f.read_at(end - begin, begin).rfind(b"\n")
            if at >= 0:
                return begin + at + 1
            end = begin
    return start


def parts(file: str, start: int, end: int, size: int) -> list[Part]:
    return [Part(file, at, min(at + size, end), end) for at in range(start, end, size)]


def read_part(path: str, part: Part) -> Iterator[pa.RecordBatch]:
    store, _ = _opened(path)
    name, held = part.file.rsplit("/", 1)[-1], []
    with store.open_input_file(part.file) as f:
        at, rest = part.start, b""
        skip = part.start > 0 and f.read_at(1, part.start - 1) != b"\n"  # the line that begins before belongs to the part before
        while at < part.known:
            data = f.read_at(min(LOOK, part.known - at), at)
            if not data:
                break
            begin = at - len(rest)
            at += len(data)
            *lines, rest = (rest + data).split(b"\n")
            for line in lines:
                if skip:
                    skip = False
                elif begin >= part.end:
                    break
                elif line.strip():
                    held.append((begin, line.removesuffix(b"\r").decode("utf-8", "replace")))
                begin += len(line) + 1
            if len(held) >= LINES:
                yield _batch(name, held)
                held = []
            if begin >= part.end:
                break
    if held:
        yield _batch(name, held)


def _batch(name: str, held: list[tuple[int, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([name] * len(held)), pa.array([a for a, _ in held], pa.int64()), pa.array([t for _, t in held])], names=["file", "at", "line"])


class MeterLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "meter_lines"

    def schema(self) -> str:
        return "file string, at bigint, line string"

    def reader(self, schema) -> DataSourceReader:
        return LinesReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return LinesStream(self.options)


class LinesReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.suffix, self.size = options["path"], options.get("suffix", ""), int(options.get("part_bytes", PART))

    def partitions(self) -> list[Part]:
        found = [p for file, size in sorted(sizes(self.path, self.suffix).items()) for p in parts(file, 0, whole_lines(self.path, file, 0, size), self.size)]
        return found or [Part("", 0, 0, 0)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return read_part(self.path, partition) if partition.file else iter(())


class LinesStream(DataSourceStreamReader):
    def __init__(self, options):
        self.path, self.suffix, self.size = options["path"], options.get("suffix", ""), int(options.get("part_bytes", PART))
        self.seen: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        for file, size in sizes(self.path, self.suffix).items():
            before = self.seen.get(file, 0)
            end = whole_lines(self.path, file, before, size)
            if end > before:
                self.seen[file] = end
        return dict(sorted(self.seen.items()))

    def partitions(self, start: dict, end: dict) -> list[Part]:
        self.seen = {**end, **self.seen}
        return [p for file, to in sorted(end.items()) for p in parts(file, start.get(file, 0), to, self.size)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return read_part(self.path, partition)

    def commit(self, end: dict) -> None:
        """Lines stay where they are."""
