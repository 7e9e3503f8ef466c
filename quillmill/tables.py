"""Intermediate tables in the folder that driver and executors share.

``cut`` writes a frame as Parquet under ``spark.checkpoint.dir`` and reads it back, which
cuts lineage in a way that survives lost executors and is never recomputed.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one only where it is unset and local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="quillmill-")
    spark.sparkContext.setCheckpointDir(made)
    spark.conf.set("spark.checkpoint.dir", made)
    return made


#: On a ``file:`` folder: no checksum file, and so no extra process, for each part. Other stores
#: do not see these options.
_PLAIN = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def cut(df: DataFrame, name: str = "t", rows: int | None = None, each: int = 500_000) -> DataFrame:
    """Write ``df`` to the shared folder and return a frame that reads the written table.

    ``rows`` is a known bound on its rows: then no more than one task and file for ``each`` of
    them are made, where a table of few rows would else be as many files as the exchange before.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // each)))
    path = f"{shared_dir(spark).rstrip('/')}/quillmill/{re.sub(r"[^A-Za-z0-9]+", "_", name)}-{uuid.uuid4().hex}"
    df.write.options(**_PLAIN).parquet(path)
    _WRITTEN.append((spark, path))
    made = spark.read.schema(df.schema).parquet(path)
    made.cut_path = path
    return made


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def discard(df: DataFrame) -> None:
    """Delete the table behind a frame that ``cut`` returned, once nothing reads it any more."""
    if path := getattr(df, "cut_path", None):
        _delete(df.sparkSession, path)
        _WRITTEN[:] = [x for x in _WRITTEN if x[1] != path]


def clear() -> None:
    """Delete what ``cut`` has written; frames that still read it end here."""
    while _WRITTEN:
        try:
            _delete(*_WRITTEN.pop())
        except Exception:  # the session may be gone at exit
            return


atexit.register(clear)
