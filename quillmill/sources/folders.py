"""Folders of many files, listed, read and written by tasks through Arrow's file systems.

Neither names nor contents meet in the driver: a level of folders is listed by tasks into a table, then the next.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import cut
from .dataset import filesystem

#: Folders that one task lists, and files that one reads, about.
EACH = 2000
#: Entries and bytes of a batch, about.
ROWS, BYTES = 1000, 1 << 23


def address(path: str) -> str | None:
    """The whole address of a folder that Arrow can list; None for globs, files and stores it does not know."""
    if re.search(r"[*?\[\]{}\\]", path):
        return None
    plain = re.sub("^file:/+", "/", path)
    plain = plain if "://" in plain else os.path.abspath(plain)
    try:
        files, inner = filesystem(plain)
        if not plain.rstrip("/").endswith(inner.rstrip("/")) or files.get_file_info(inner).type != fs.FileType.Directory:
            return None
    except (OSError, ValueError):
        return None
    return plain.rstrip("/") or "/"


def _hidden(name: str) -> bool:
    """Names that Spark's readers pass over."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for folder in batch.column(0).to_pylist():
            files, inner = filesystem(folder)
            if isinstance(files, fs.LocalFileSystem):
                with os.scandir(inner) as inside:
                    found = [(x.name, x.is_dir()) for x in inside]
            else:
                found = [(x.base_name, x.type == fs.FileType.Directory) for x in files.get_file_info(fs.FileSelector(inner))]
            found = [(f"{folder.rstrip('/')}/{name}", deep) for name, deep in found if not _hidden(name)]
            for at in range(0, len(found), 10 * ROWS):
                names, deep = zip(*found[at : at + 10 * ROWS], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(deep)], names=["path", "folder"])


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """(path) of all files below a folder, hidden ones left out."""
    level, found = spark.createDataFrame([(folder,)], "path string"), None
    while True:
        seen = cut(level.mapInArrow(_entries, "path string, folder boolean"), "listed")
        files, folders = seen.where("not folder").select("path"), seen.where("folder").select("path")
        found = files if found is None else found.union(files)
        if not (number := folders.count()):
            return found
        level = folders.repartition(-(-number // EACH))


def contents(path: str) -> bytes:
    files, inner = filesystem(path)
    with files.open_input_stream(inner, compression=None) as file:
        return file.read()


def _made(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, inner = filesystem(folder)
        task, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            for place, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                files.create_dir(f"{inner}/{place}", recursive=True)
                with files.open_output_stream(f"{inner}/{place}/{task:06d}-{n}.txt", compression=None) as out:
                    out.write((text or "").encode() + b"\n")
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return run


def write_texts(rows: DataFrame, folder: str) -> int:
    """Write each row (place, text) as a file of its own in the folder ``place`` below ``folder``; their number."""
    plain = re.sub("^file:/+", "/", folder).rstrip("/")
    return rows.select("place", "text").mapInArrow(_made(plain), "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
