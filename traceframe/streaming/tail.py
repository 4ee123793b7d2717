"""A streaming source of whole lines from files that grow.

The offset of the stream is the size of every file as last seen. A batch covers the bytes that a file gained, cut into
ranges that are tasks; a line belongs to the range that holds its line break, so a line still being written waits for its
break, and one that crosses a border is read once, by the later range. A file that is smaller than its offset was
written anew and is read from its start. Files are listed and opened through Arrow's file systems, on the driver only
listed.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

NAME = "traceframe_tail"
#: Bytes of one task, and of one step back to the start of a line.
RANGE = 32 << 20
BACK = 1 << 16


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri)


def sizes(folder: str) -> dict[str, int]:
    """Path and size of every file under the folder; hidden ones are left out."""
    from pyarrow import fs

    system, path = _open(folder)
    listed = system.get_file_info(fs.FileSelector(path, allow_not_found=True, recursive=True))
    return {f.path: f.size for f in listed if f.is_file and not f.base_name.startswith((".", "_"))}


def line_start(file, at: int) -> int:
    """Where the line that holds the byte before ``at`` begins, or ``at`` if that byte ends a line."""
    while at > 0:
        step = min(BACK, at)
        file.seek(at - step)
        found = file.read(step).rfind(b"\n")
        if found >= 0:
            return at - step + found + 1
        at -= step
    return 0


def lines_between(file, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(byte offset, line) of every line whose break lies in [start, end)."""
    begin = line_start(file, start)
    file.seek(begin)
    rest, at = b"", begin
    left = end - begin
    while left > 0:
        data = file.read(min(1 << 20, left))
        if not data:
            break
        left -= len(data)
        *whole, rest = (rest + data).split(b"\n")
        for line in whole:
            yield at, line
            at += len(line) + 1


class Range(InputPartition):
    def __init__(self, folder: str, path: str, start: int, end: int):
        super().__init__((folder, path, start, end))


class TailReader(DataSourceStreamReader):
    def __init__(self, folder: str, max_bytes: int | None):
        self.folder, self.max_bytes, self.known = folder, max_bytes, {}

    def initialOffset(self) -> dict:  # noqa: N802
        return {"files": "{}"}

    def latestOffset(self) -> dict:  # noqa: N802
        now = sizes(self.folder)
        if self.max_bytes is not None:
            budget, bounded = self.max_bytes, {}
            for path in sorted(now):
                before = min(self.known.get(path, 0), now[path])
                bounded[path] = before + max(0, min(now[path] - before, budget))
                budget -= bounded[path] - before
            now = bounded
        self.known = now
        return {"files": json.dumps(now, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        before, after = json.loads(start["files"]), json.loads(end["files"])
        self.known = after
        out = []
        for path, size in sorted(after.items()):
            at = before.get(path, 0)
            at = 0 if size < at else at
            out += [Range(self.folder, path, k, min(k + RANGE, size)) for k in range(at, size, RANGE)]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        folder, path, start, end = partition.value
        system, _ = _open(folder)
        found, held = [], 0
        with system.open_input_file(path) as file:
            for at, line in lines_between(file, start, end):
                found.append((path, at, line.decode("utf-8", "replace").removesuffix("\r")))
                held += len(line)
                if held > 4 << 20:
                    yield batch_of(found)
                    found, held = [], 0
        if found:
            yield batch_of(found)


def batch_of(rows: list[tuple[str, int, str]]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in enumerate(kinds)], names=["trace_id", "file_index", "line"])


class TailSource(DataSource):
    """``spark.readStream.format(NAME).load(folder)``: trace_id (the file), file_index (byte offset of the line), line."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "trace_id string, file_index bigint, line string"

    def streamReader(self, schema) -> TailReader:  # noqa: N802
        limit = self.options.get("maxBytes")
        return TailReader(self.options["path"], int(limit) if limit else None)
