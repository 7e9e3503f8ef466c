"""Datasets of part files that appear as a whole or not at all, as a data source.

Each task writes one part beside the dataset and reports its name, rows and SHA-256, taken while it
writes, so nothing is read again to count or hash it. Once all tasks are done the parts, with a
manifest of these reports, take the place of what was there; where a task fails they are
removed, and an earlier dataset stays. An attempt that was lost leaves a part that no report names;
it is removed too.

Parts are written through Arrow's file systems (local paths, and the stores whose addresses these know).
"""

from __future__ import annotations

import hashlib
import json
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

#: Begins with an underscore, so that readers of the folder pass it over.
MANIFEST = "_manifest.json"


@dataclass
class Part(WriterCommitMessage):
    name: str
    records: int
    sha256: str


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of an address; OSError or ValueError where Arrow knows none."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes]]:
    """(rows, bytes) of each batch: its texts, each with a line end."""
    for batch in batches:
        column = batch.column(0)
        yield len(column), "".join([f"{x}\n" for x in column.to_pylist()]).encode()


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, run: str):
        self.path, self.aside = path.rstrip("/"), f"{path.rstrip('/')}.writing-{run}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part | None:
        context = TaskContext.get()
        name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}.jsonl"
        files, folder = filesystem(self.aside)
        files.create_dir(folder, recursive=True)
        rows, digest = 0, hashlib.sha256()
        with files.open_output_stream(f"{folder}/{name}") as out:
            for number, data in _lines(iterator):
                out.write(data)
                digest.update(data)
                rows += number
        return Part(name, rows, digest.hexdigest())

    def commit(self, messages: list[Part | None]) -> None:
        files, folder = filesystem(self.aside)
        files.create_dir(folder, recursive=True)
        parts = sorted((m for m in messages if m is not None and m.records), key=lambda m: m.name)
        known = {m.name for m in parts}
        for info in files.get_file_info(fs.FileSelector(folder)):
            if info.base_name not in known:
                files.delete_file(info.path)
        told = {"records": sum(m.records for m in parts), "files": [{"name": m.name, "records": m.records, "sha256": m.sha256} for m in parts]}
        with files.open_output_stream(f"{folder}/{MANIFEST}") as out:
            out.write(json.dumps(told, indent=2).encode())
        target = filesystem(self.path)[1]
        there = files.get_file_info(target).type
        old = f"{target}.old-{uuid.uuid4().hex}"
        if there != fs.FileType.NotFound:
            files.move(target, old)
        files.move(folder, target)
        if there == fs.FileType.Directory:
            files.delete_dir(old)
        elif there == fs.FileType.File:
            files.delete_file(old)

    def abort(self, messages: list[Part | None]) -> None:
        files, folder = filesystem(self.aside)
        if files.get_file_info(folder).type == fs.FileType.Directory:
            files.delete_dir(folder)


class Dataset(DataSource):
    """One string column, written as lines to the folder of the option ``path``."""

    @classmethod
    def name(cls) -> str:
        return "quillmill_dataset"

    def schema(self) -> str:
        return "value string"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], self.options["run"])


def write(rows: DataFrame, path: str) -> dict:
    """Write ``value``, partition by partition, as the dataset at ``path``; its manifest (records, files)."""
    spark = rows.sparkSession
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # committers may not see this library
    spark.dataSource.register(Dataset)
    rows.select("value").write.format(Dataset.name()).mode("append").option("run", uuid.uuid4().hex).option("path", path).save()
    files, folder = filesystem(path)
    with files.open_input_stream(f"{folder.rstrip('/')}/{MANIFEST}") as file:
        return json.loads(file.read())
