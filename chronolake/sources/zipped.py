"""Members of ZIP archives as a Spark data source: an archive is read in ranges by many tasks and never held whole.

A partition is a range of an archive's bytes. Its task reads the central directory and then the members whose headers lie in
its range, one after the other. Archives lie in any store that pyarrow opens by its address.
"""

from __future__ import annotations

import fnmatch
import re
import zipfile
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "archive string, key string, payload string, problem string"
#: Bytes of an archive that a task reads, and of a member's text beyond which it is not read.
RANGE_BYTES, MOST_BYTES = 32 << 20, 1 << 30
#: Members, and characters of them, that are sent on at once.
BATCH_ROWS, BATCH_CHARS = 256, 8 << 20


@dataclass
class Range(InputPartition):
    """The ``number``-th of ``of`` ranges of an archive."""

    path: str
    size: int
    number: int
    of: int

    def holds(self, offset: int) -> bool:
        return self.number * self.size <= offset * self.of < (self.number + 1) * self.size


def opened(address: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", address))


def files(address: str) -> list[fs.FileInfo]:
    """The file, the files of the folder, or those whose name fits the last part's pattern."""
    store, path = opened(address)
    folder, _, name = path.rstrip("/").rpartition("/")
    if any(x in name for x in "*?["):
        found = [i for i in store.get_file_info(fs.FileSelector(folder)) if fnmatch.fnmatch(i.base_name, name)]
    else:
        own = store.get_file_info(path)
        if own.type == fs.FileType.NotFound:
            raise FileNotFoundError(address)
        found = store.get_file_info(fs.FileSelector(path)) if own.type == fs.FileType.Directory else [own]
    return sorted((i for i in found if i.type == fs.FileType.File and i.base_name[0] not in "._"), key=lambda i: i.path)


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.pattern = options["path"], options.get("pattern", "")
        self.each, self.most = int(options.get("rangebytes", RANGE_BYTES)), int(options.get("mostbytes", MOST_BYTES))

    def partitions(self) -> list[Range]:
        """Ranges of about equal size; only names and sizes of the archives are looked at here."""
        out = []
        for info in files(self.path):
            n = max(1, -(-info.size // self.each))
            out += [Range(info.path, max(1, info.size), k, n) for k in range(n)]
        return out

    def rows(self, part: Range) -> Iterator[tuple[str, str | None, str | None, str | None]]:
        store, _ = opened(self.path)
        with store.open_input_file(part.path) as file:
            try:
                archive = zipfile.ZipFile(file)
            except (zipfile.BadZipFile, OSError, pa.ArrowInvalid):
                if part.number == 0:
                    yield part.path, None, None, "not an archive"
                return
            fits = [i for i in archive.infolist() if not i.is_dir() and re.search(self.pattern, i.filename)]
            names = Counter(i.filename.rsplit("/", 1)[-1] for i in fits)
            for info in fits:
                if not part.holds(info.header_offset):
                    continue
                name, text, problem = info.filename.rsplit("/", 1)[-1], None, None
                if info.file_size > self.most:
                    problem = "member is too large"
                else:
                    try:
                        text = archive.read(info).decode("utf-8")
                        problem = "member stands twice" if names[name] > 1 else None
                    except (UnicodeDecodeError, zipfile.BadZipFile, zlib.error, EOFError, RuntimeError, NotImplementedError, pa.ArrowInvalid):
                        problem = "member can't be read"
                yield part.path, name, text, problem

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        names = ["archive", "key", "payload", "problem"]
        rows, chars = [], 0
        for row in self.rows(partition):
            rows.append(row)
            chars += len(row[2] or "")
            if len(rows) == BATCH_ROWS or chars >= BATCH_CHARS:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=names)
                rows, chars = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=names)


class ZipMembers(DataSource):
    """Options: path, pattern (of names), rangeBytes, mostBytes."""

    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def read(spark: SparkSession, path: str, pattern: str = "", range_bytes: int = RANGE_BYTES, most_bytes: int = MOST_BYTES) -> DataFrame:
    """archive, key, payload, problem of the members whose name fits ``pattern``; see ``archives.members``."""
    spark.dataSource.register(ZipMembers)
    return spark.read.format("zip_members").options(pattern=pattern, rangeBytes=str(range_bytes), mostBytes=str(most_bytes)).load(path)
