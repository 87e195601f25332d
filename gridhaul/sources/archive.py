"""Tables as members of ZIP archives: a data source with reader and writer.

Reading takes a partition a member and streams it, so the archive is never unpacked whole; members of 4 GB and more (ZIP64) do. Columns go by header name, all
of them text: the schema is the given one, or the header of the first member. A byte-order mark is skipped, broken bytes become U+FFFD,
columns that a member lacks are null, short rows too, longer rows lose what is beyond. Members are those that the glob of option `members` matches
(*.csv). Paths are folders or files that all executors reach, plain or as file:, hdfs: or s3: addresses.

Writing gives one archive a task, with one member of CSV; files get their names when all tasks are done, so a failed or repeated task leaves nothing.

    spark.dataSource.register(ZippedTables)
    spark.read.format("zipped_tables").load(path)
"""

from __future__ import annotations

import csv
import fnmatch
import io
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StringType, StructField, StructType

ROWS = 5_000  # in a batch


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)


def _members(path: str, glob: str) -> list[tuple[str, str]]:
    """Archives and the names of their members that match, in order."""
    store, root = _opened(path)
    kind = store.get_file_info(root)
    found = [kind] if kind.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, recursive=True))
    files = sorted(f.path for f in found if f.type == fs.FileType.File and f.path.lower().endswith(".zip") and not f.base_name.startswith(("_", ".")))
    out = []
    for file in files:
        with store.open_input_file(file) as raw, zipfile.ZipFile(raw) as z:
            out += [(file, i.filename) for i in z.infolist() if not i.is_dir() and fnmatch.fnmatch(i.filename.rsplit("/", 1)[-1].lower(), glob)]
    return out


def _rows(store: fs.FileSystem, file: str, member: str) -> Iterator[list[str]]:
    with store.open_input_file(file) as raw, zipfile.ZipFile(raw) as z, z.open(member) as inner:
        yield from csv.reader(io.TextIOWrapper(inner, encoding="utf-8-sig", errors="replace", newline=""))


@dataclass
class Member(InputPartition):
    file: str
    name: str


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, glob: str, columns: list[str]):
        self.path, self.glob, self.columns = path, glob, columns

    def partitions(self) -> list[Member]:
        return [Member(file, name) for file, name in _members(self.path, self.glob)]

    def read(self, partition: Member) -> Iterator[pa.RecordBatch]:
        store, _ = _opened(self.path)
        rows = _rows(store, partition.file, partition.name)
        head = {name.strip().lower(): k for k, name in enumerate(next(rows, []))}
        places = [head.get(c.lower(), -1) for c in self.columns]
        held: list[list[str | None]] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*held, strict=True)], names=self.columns)

        for row in rows:
            if row:
                held.append([row[k] if 0 <= k < len(row) else None for k in places])
            if len(held) == ROWS:
                yield batch()
                held.clear()
        if held:
            yield batch()


@dataclass
class Written(WriterCommitMessage):
    name: str


class ArchiveWriter(DataSourceArrowWriter):
    def __init__(self, path: str, columns: list[str]):
        self.path, self.columns, self.job = path, columns, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = _opened(self.path)
        store.create_dir(root, recursive=True)
        name = f"{self.job}-{uuid.uuid4().hex}.zip"
        with store.open_output_stream(f"{root}/_{name}") as raw, zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z, z.open("rows.csv", "w", force_zip64=True) as inner:
            text = io.TextIOWrapper(inner, encoding="utf-8-sig", newline="")
            rows = csv.writer(text)
            rows.writerow(self.columns)
            for b in iterator:
                rows.writerows(zip(*(c.to_pylist() for c in b.columns), strict=True))
            text.flush()
            text.detach()
        return Written(name)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = _opened(self.path)
        for m in messages:
            if m is not None:
                store.move(f"{root}/_{m.name}", f"{root}/{m.name}")
        self._sweep()

    def abort(self, messages: list[Written | None]) -> None:
        self._sweep()

    def _sweep(self) -> None:
        """Files of this job's tasks that failed or ran twice."""
        store, root = _opened(self.path)
        for f in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            if f.base_name.startswith(f"_{self.job}-"):
                store.delete_file(f.path)


class ZippedTables(DataSource):
    @classmethod
    def name(cls) -> str:
        return "zipped_tables"

    def schema(self) -> StructType:
        path, glob = self.options["path"], self.options.get("members", "*.csv")
        store, _ = _opened(path)
        for file, name in _members(path, glob):
            return StructType([StructField(c.strip(), StringType()) for c in next(_rows(store, file, name), [])])
        raise ValueError(f"no member that {glob} matches in {path}")

    def reader(self, schema: StructType) -> ArchiveReader:
        return ArchiveReader(self.options["path"], self.options.get("members", "*.csv"), schema.fieldNames())

    def writer(self, schema: StructType, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options["path"], schema.fieldNames())
