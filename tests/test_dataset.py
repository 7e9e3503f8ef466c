"""Datasets as folders of parts: whole or not there, counted and hashed while they are written."""

import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from quillmill.operators import messages as M
from quillmill.plans import build
from quillmill.sources import dataset, readers, sinks


def examples(spark, n, tail=""):
    rows = spark.range(n).select(F.col("id").alias("seq"), F.concat(F.lit("é text "), "id", F.lit(tail)).alias("text"))
    return rows.select("seq", F.lit(0).cast("long").alias("sub"), F.lit("s").alias("source"), M.qa(F.lit("ask"), F.col("text")).alias("messages")).repartition(5)


@pytest.fixture
def apart(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_a_folder_of_parts(apart, tmp_path):
    spark, out = apart, str(tmp_path / "data.jsonl")
    writer = sinks.JsonlWriter(single_file=False)
    assert writer.write(examples(spark, 300), out) == 300
    told = writer.written[out]
    names = sorted(x for x in os.listdir(out) if x.startswith("part-"))
    assert [f["name"] for f in told["files"]] == names and sum(f["records"] for f in told["files"]) == 300 and len(names) > 1
    for f in told["files"]:
        with open(f"{out}/{f['name']}", "rb") as file:
            data = file.read()
        assert hashlib.sha256(data).hexdigest() == f["sha256"] and data.count(b"\n") == f["records"]
    text = "".join(open(f"{out}/{n}", encoding="utf-8").read() for n in names)
    assert [json.loads(x)["messages"][1]["content"] for x in text.splitlines()] == [f"é text {i}" for i in range(300)]
    assert readers.read_examples(spark, out).count() == 300  # the folder's manifest is no part of it
    with open(f"{out}/{dataset.MANIFEST}") as file:
        assert json.load(file) == told


def test_a_failed_job_leaves_what_was_there(spark, tmp_path):
    out = str(tmp_path / "data")
    dataset.write(examples(spark, 10).select(F.lit("old").alias("value")), out)
    bad = spark.range(100).repartition(4).select(F.when(F.col("id") == 77, F.raise_error(F.lit("lost")).cast("string")).otherwise(F.lit("new")).alias("value"))
    with pytest.raises(Exception, match="lost"):
        dataset.write(bad, out)
    assert spark.read.text(out).distinct().collect()[0][0] == "old" and os.listdir(tmp_path) == ["data"]
    assert dataset.write(spark.createDataFrame([], "value string"), out) == {"records": 0, "files": []}
    assert os.listdir(tmp_path) == ["data"] and os.listdir(out) == [dataset.MANIFEST]
    (tmp_path / "file").write_text("x")
    assert dataset.write(examples(spark, 3).select(F.lit("a").alias("value")), str(tmp_path / "file"))["records"] == 3


def test_builds_take_over_counts_and_hashes(spark, tmp_path, monkeypatch):
    """One file: its hash is taken while parts are joined, and nothing is read again."""
    monkeypatch.setattr(build.paths, "sha256", lambda *a: pytest.fail("read again"))
    out = str(tmp_path / "one.jsonl")
    made = build.build_examples(examples(spark, 40), out, steps=[], validation_fraction=0.25)
    for entry in made.manifest["output"]["files"]:
        with open(tmp_path / entry["name"], "rb") as file:
            data = file.read()
        assert entry["sha256"] == hashlib.sha256(data).hexdigest() and entry["records"] == data.count(b"\n")
    assert [e["records"] for e in made.manifest["output"]["files"]] == [30, 10]
