"""Ledgers as a Spark data source: JSON maps by id, a partition for each file, written whole or not at all.

``spark.read.format("json_ledger").option("kind", "failures").load(path)``
``df.write.format("json_ledger").option("kind", "failures").mode("overwrite").save(path)``
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

from pyarrow import fs
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Columns of each kind of ledger behind the id; a map of plain strings has one.
KINDS = {"failures": "paper_id string, url string, reason string, attempts int, detail string", "urls": "paper_id string, url string"}


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[str]:
    """The ledger's files, in order; what a run has left under a name with ``_`` or ``.`` is none."""
    at, root = _place(path)
    info = at.get_file_info(root)
    if info.type == fs.FileType.File:
        return [root]
    found = at.get_file_info(fs.FileSelector(root, recursive=False, allow_not_found=True))
    return sorted(f.path for f in found if f.type == fs.FileType.File and f.base_name.endswith(".json") and f.base_name[0] not in "_.")


@dataclass
class File(InputPartition):
    path: str


@dataclass
class Written(WriterCommitMessage):
    path: str | None


class LedgerReader(DataSourceReader):
    """A partition for each file. A file that is broken, or no map, holds nothing, as an absent one does."""

    def __init__(self, path: str, schema: StructType):
        self.path, self.names = path, schema.names

    def partitions(self) -> list[InputPartition]:
        return [File(p) for p in _files(self.path)] or [File("")]

    def read(self, partition: File) -> Iterator[tuple]:
        if not partition.path:
            return
        with _place(self.path)[0].open_input_stream(partition.path) as f:
            try:
                found = json.loads(f.read().decode())
            except ValueError:
                return
        for key, value in found.items() if isinstance(found, dict) else ():
            if isinstance(value, dict):
                yield (key, *(value.get(n) for n in self.names[1:]))
            else:
                yield (key, value, *[None] * (len(self.names) - 2))


class LedgerWriter(DataSourceWriter):
    """Tasks write aside; the commit moves their files in and then removes the old ones, an abort removes theirs (a task that ends after it may leave one aside, which nobody reads). A ledger without rows is no file at all."""

    def __init__(self, path: str, schema: StructType, overwrite: bool):
        self.path, self.names, self.overwrite, self.run = path, schema.names, overwrite, uuid.uuid4().hex

    def write(self, rows: Iterator[Row]) -> WriterCommitMessage:
        held: dict[str, Any] = {}
        for r in rows:
            values = dict(zip(self.names[1:], list(r)[1:], strict=True))
            held[r[0]] = next(iter(values.values())) if len(values) == 1 else {k: v for k, v in values.items() if v is not None}
        if not held:
            return Written(None)
        at, root = _place(self.path)
        aside = f"{root}/_staging-{self.run}"
        at.create_dir(aside, recursive=True)
        path = f"{aside}/{uuid.uuid4().hex}.json"
        with at.open_output_stream(path) as f:
            f.write(json.dumps(held, ensure_ascii=False, sort_keys=True).encode())
        return Written(path)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        at, root = _place(self.path)
        old = _files(self.path) if self.overwrite else []
        for m in messages:
            if m is not None and m.path:
                at.move(m.path, f"{root}/{self.run}-{m.path.rsplit('/', 1)[1]}")
        for p in old:
            at.delete_file(p)
        self._clear()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        at, root = _place(self.path)
        aside = f"{root}/_staging-{self.run}"
        if at.get_file_info(aside).type == fs.FileType.Directory:
            at.delete_dir(aside)


class Ledger(DataSource):
    @classmethod
    def name(cls) -> str:
        return "json_ledger"

    def schema(self) -> str:
        return KINDS[self.options.get("kind", "failures")]

    def reader(self, schema: StructType) -> DataSourceReader:
        return LedgerReader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return LedgerWriter(self.options["path"], schema, overwrite)


def register(spark: SparkSession) -> None:
    """Make the format ``json_ledger`` known to the session."""
    spark.dataSource.register(Ledger)
