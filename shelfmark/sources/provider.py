"""Landed provider pages as a Spark data source, for batch and for streams.

    spark.dataSource.register(LandedPages)
    spark.read.format("landed_pages").option("path", folder).load()
    spark.readStream.format("landed_pages").option("path", folder).load()

Rows are (file, body): one page of a provider's answer, for the adapters' `parse_pages`. Any file
system that pyarrow knows is read. A stream's offset is the time and name of the newest file it
has seen; files land whole (by rename) and not with an earlier time than those before them.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, InputPartition,
)
from pyspark.sql.types import StructType

SCHEMA = "file STRING, body STRING"
#: Files of one task.
FILES = 64


def _files(path: str) -> list[tuple[int, str]]:
    """(time in nanoseconds, path) of the landed files, oldest first."""
    from pyarrow import fs
    place, root = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:")
                                         else "file://" + path)
    found = place.get_file_info(fs.FileSelector(root, allow_not_found=True))
    return sorted((f.mtime_ns or 0, f.path) for f in found
                  if f.type == fs.FileType.File and f.base_name[:1] not in "._")


class Pages(InputPartition):
    def __init__(self, files: list[str]) -> None:
        super().__init__(None)
        self.files = files


def _deal(files: list[tuple[int, str]], size: int) -> list[Pages]:
    names = [name for _, name in files]
    return [Pages(names[a:a + size]) for a in range(0, len(names), size)]


class _Reading:
    def __init__(self, options: dict) -> None:
        if not options.get("path"):
            raise ValueError("landed_pages needs the option path")
        self.path = options["path"]
        self.size = int(options.get("filesPerTask", FILES))

    def read(self, partition: Pages) -> Iterator[tuple[str, str]]:
        from pyarrow import fs
        place, _ = fs.FileSystem.from_uri(self.path if "://" in self.path or
                                          self.path.startswith("file:") else "file://" + self.path)
        for name in partition.files if partition is not None else ():
            with place.open_input_stream(name) as page:
                yield name, page.read().decode("utf-8")


class PagesReader(_Reading, DataSourceReader):
    def partitions(self) -> list[Pages]:
        return _deal(_files(self.path), self.size) or [Pages([])]


class PagesStream(_Reading, DataSourceStreamReader):
    """Offsets are {"at": time, "file": name}; a micro-batch reads what lies between two."""

    def initialOffset(self) -> dict:  # noqa: N802
        return {"at": -1, "file": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        files = _files(self.path)
        return {"at": files[-1][0], "file": files[-1][1]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        after, last = ((o["at"], o["file"]) for o in (start, end))
        return _deal([f for f in _files(self.path) if after < f <= last], self.size) or [Pages([])]

    def commit(self, end: dict) -> None:
        """Landed files stay: other readers may need them."""


class LandedPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "landed_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> PagesReader:
        return PagesReader(self.options)

    def streamReader(self, schema: StructType) -> PagesStream:  # noqa: N802
        return PagesStream(self.options)


# Executors get the data source itself, so they need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
