"""Following a growing line file."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from tracewell.sources.ship import ship


class _Range(InputPartition):
    def __init__(self, start: int, stop: int, first: bool):
        super().__init__(None)
        self.start, self.stop, self.first = start, stop, first


class LineTail(DataSource):
    """Complete lines of one growing file with their byte offsets.

    Offsets are byte positions after a line feed, so a partly written line waits for its rest. The
    offset log of the stream is the only cursor: after a restart the batch goes from the offset it
    holds. A file that is shorter than what was read raises. ``maxBytes`` bounds a batch once the
    reader knows where it stands, and the bytes of one partition always; the lines of a partition are
    those that begin in it. Lines are read by executors, so the file must lie where they can open it.
    """

    @classmethod
    def name(cls) -> str:
        return "line_tail"

    def schema(self) -> str:
        return "start long, line string"

    def streamReader(self, schema):
        return _TailReader(self.options)


class _TailReader(DataSourceStreamReader):
    def __init__(self, options):
        self.path, self.most = options["path"], int(options.get("maxBytes", 16 << 20))
        self.begin = int(options.get("startOffset", 0))
        self.known: int | None = None  # what this reader has seen read; nothing after a restart

    def initialOffset(self) -> dict:
        return {"bytes": self.begin}

    def latestOffset(self) -> dict:
        size = os.path.getsize(self.path)
        at = self.known
        if at is not None and size < at:
            raise ValueError(f"{self.path} was rewound: {size} bytes, {at} already read")
        if at is None or size - at <= self.most:
            return {"bytes": max(_last_line_end(self.path, size), at or 0)}
        return {"bytes": _last_line_end(self.path, at + self.most, at) or _next_line_end(self.path, at + self.most)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        a, z = start["bytes"], end["bytes"]
        if z < a:
            raise ValueError(f"{self.path} was rewound: lines end at {z}, {a} already read")
        self.known = z
        return [_Range(lo, min(lo + self.most, z), lo == a) for lo in range(a, z, self.most)]

    def read(self, partition: _Range) -> Iterator[tuple[int, str]]:
        with open(self.path, "rb") as f:
            at = partition.start
            if not partition.first:
                f.seek(at - 1)
                at += len(f.readline()) - 1
            f.seek(at)
            while at < partition.stop:
                line = f.readline()
                if not line.endswith(b"\n"):
                    raise ValueError(f"{self.path} ended at {at + len(line)} while it was read")
                yield at, line[:-1].decode("utf-8", "replace")
                at += len(line)

    def commit(self, end: dict) -> None:
        self.known = max(self.known or 0, end["bytes"])


def _last_line_end(path: str, stop: int, floor: int = 0, step: int = 1 << 16) -> int:
    """The place after the last line feed in [floor, stop), 0 if there is none."""
    with open(path, "rb") as f:
        while stop > floor:
            lo = max(floor, stop - step)
            f.seek(lo)
            if (at := f.read(stop - lo).rfind(b"\n")) >= 0:
                return lo + at + 1
            stop = lo
    return 0


def _next_line_end(path: str, at: int) -> int:
    """The place after the line that ``at`` lies in; a line longer than a batch still makes one."""
    with open(path, "rb") as f:
        f.seek(at)
        line = f.readline()
        return at + len(line) if line.endswith(b"\n") else _last_line_end(path, at)


def follow(spark: SparkSession, path: str, **options) -> DataFrame:
    ship(spark)
    spark.dataSource.register(LineTail)
    return spark.readStream.format("line_tail").option("path", path).options(**options).load()
