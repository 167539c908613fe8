"""Daily Markdown logs that grow, as a stream of whole sections.

An offset is the size of each file that was seen, and whether a file of a later day was there, after which
a log is taken as closed. A batch holds the sections whose end came into a file since the last one: the
next heading, or the file's end once it is closed. Files are read by the executors, from the last heading
before what is new; the driver only lists them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

HEAD = b"\n## "
#: Bytes that are read at a time in looking back for a section's heading.
BACK = 1 << 16
_DAY = re.compile(r"\d{4}-\d{2}-\d{2}\.md")


class Part(InputPartition):
    """What came to a file."""

    def __init__(self, path: str, start: int, end: int, closes: bool) -> None:
        self.path, self.start, self.end, self.closes = path, start, end, closes


def sections_between(read: object, start: int, end: int, closes: bool) -> Iterator[tuple[int, bytes]]:
    """(place, text after the heading's mark) of the sections that end in bytes start to end of a file; ``read(a, b)`` gives its bytes."""
    first = max(0, start - len(HEAD) + 1)  # a mark may have been cut
    data, at = read(first, end), first
    while at and HEAD not in data[: max(0, start - at)]:  # back to the heading of the section that goes on here
        more = max(0, at - BACK)
        data, at = read(more, at) + data, more
        if HEAD in data[: start - at]:
            break
    marks = [m.start() for m in re.finditer(re.escape(HEAD), data)]
    before = [m for m in marks if at + m + len(HEAD) <= start]
    marks = before[-1:] + [m for m in marks if at + m + len(HEAD) > start]
    ends = marks[1:] + ([len(data)] if closes and marks else [])
    for a, b in zip(marks, ends):
        yield at + a, data[a + len(HEAD) : b]


class LiveLogs(DataSource):
    """Format ``live_logs``, option ``folder`` (a URI that pyarrow can open): date, at (the section's place in bytes) and part."""

    @classmethod
    def name(cls) -> str:
        return "live_logs"

    def schema(self) -> str:
        return "date string, at long, part string"

    def streamReader(self, schema: StructType) -> LiveReader:  # noqa: N802 (the name that Spark calls)
        return LiveReader(self.options["folder"])


class LiveReader(DataSourceStreamReader):
    def __init__(self, folder: str) -> None:
        self.folder = folder

    def _files(self) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(self.folder)

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        fs, root = self._files()
        found = sorted((f.base_name, f.size) for f in fs.get_file_info(pafs.FileSelector(root)) if f.type == pafs.FileType.File and _DAY.fullmatch(f.base_name))
        return {name: [size, int(i < len(found) - 1)] for i, (name, size) in enumerate(found)}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        out = []
        for name, (size, closed) in end.items():
            seen, was = start.get(name, [0, 0])
            if size > seen or closed > was:
                out.append(Part(name, seen, max(size, seen), bool(closed) and (not was or size > seen)))
        return out

    def read(self, partition: Part) -> Iterator[tuple]:
        fs, root = self._files()
        with fs.open_input_file(f"{root}/{partition.path}") as f:
            for at, text in sections_between(lambda a, b: f.read_at(b - a, a), partition.start, partition.end, partition.closes):
                yield partition.path.removesuffix(".md"), at, text.decode("utf-8", "replace")
