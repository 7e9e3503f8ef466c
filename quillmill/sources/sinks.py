"""Sinks: JSONL datasets, lineage and manifests."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import formats as R
from . import dataset, paths
from .readers import numbered


def encoded(examples: DataFrame, fmt: str) -> DataFrame:
    """(seq, sub, value): one JSON text an example."""
    return examples.select("seq", "sub", R.ENCODERS[R.get_format(fmt)](F.col("messages")).alias("value"))


def joined(rows: DataFrame, order: list[str], path: str) -> dict:
    """Write ``value`` in order as one file; its records and SHA-256.

    Part files are written in parallel and joined as streams in the same file system; rows never
    meet in one task, and none is read again to be counted or hashed.
    """
    spark, folder = rows.sparkSession, f"{path}.parts"
    told = parts(rows, order, folder)
    digest = paths.join_parts(spark, folder, path)
    paths.remove(spark, folder)
    return {"records": told["records"], "sha256": digest}


def parts(rows: DataFrame, order: list[str], path: str) -> dict:
    """Write ``value`` in order as a folder of part files, whose names follow the order; records and files.

    The folder takes the place of an earlier one once it is whole. Stores that Arrow does not know are
    written by Spark's own writer, and counted there.
    """
    spark = rows.sparkSession
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("value")
    try:
        dataset.filesystem(path)
    except (OSError, ValueError):
        ordered.write.mode("overwrite").text(path)
        return {"records": spark.read.text(path).count(), "files": []}
    return dataset.write(ordered, path)


def write_jsonl(examples: DataFrame, path: str, fmt: str = "openai-chat", single_file: bool = True) -> int:
    """Write examples in order and return their number.

    One file is for datasets that one reader takes; otherwise a folder of part files is written in parallel.
    """
    return JsonlWriter(fmt, single_file).write(examples, path)


class JsonlWriter:
    """Writes examples as JSONL files of one format."""

    def __init__(self, fmt: str = "openai-chat", single_file: bool = True):
        self.format, self.single_file = R.get_format(fmt), single_file

        #: What was written, by destination: records, and the file's SHA-256 or the folder's files.
        self.written: dict[str, dict] = {}

    def write(self, examples: DataFrame, destination: str) -> int:
        make = joined if self.single_file else parts
        self.written[destination] = make(encoded(examples, self.format), ["seq", "sub"], destination)
        return self.written[destination]["records"]


class InMemoryWriter:
    """Keeps encoded records by destination on the driver, for tests of small datasets."""

    def __init__(self, fmt: str = "openai-chat"):
        self.format, self.records = R.get_format(fmt), {}

    def write(self, examples: DataFrame, destination: str) -> int:
        rows = encoded(examples, self.format).orderBy("seq", "sub").collect()
        self.records[str(destination)] = [json.loads(r.value) for r in rows]
        return len(rows)


def write_lineage(train: DataFrame, validation: DataFrame, path: str) -> int:
    """One JSON line an example with its split, its place in the split's file and its source."""
    parts = [numbered(df.select(F.lit(i).alias("part"), F.lit(name).alias("split"), "seq", "sub", "source"), ["seq", "sub"], "index") for i, (name, df) in enumerate((("train", train), ("validation", validation)))]
    rows = parts[0].unionByName(parts[1])
    line = F.to_json(F.struct("split", F.col("index"), "source"), {"ignoreNullFields": "false"})
    return joined(rows.select("part", "index", line.alias("value")), ["part", "index"], path)["records"]


def lineage(train: DataFrame, validation: DataFrame) -> DataFrame:
    """(split, seq, sub, source) of every kept example."""
    return train.select(F.lit("train").alias("split"), "seq", "sub", "source").union(validation.select(F.lit("validation").alias("split"), "seq", "sub", "source"))


def write_manifest(spark: SparkSession, manifest: dict, path: str) -> None:
    paths.write_text(spark, path, json.dumps(manifest, ensure_ascii=False, indent=2) + "\n")


def read_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()[0])
