"""Queries that make blocks of documents equal their SQL where texts are empty, blank or hold blank lines, fences or other line ends."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quillmill.functions import text as T

ODD = ["", "  ", "\n", " \n\t\n", "a\n\nb", "\na", "a\n", "```\nopen", "x\n ~~~\ny", "a\r\nb", "a\x0bb\x1cc\u2028d", "\ufdd1", "\ufdd141", "a\ufdd1b", "ü\n\n" + "w" * 900]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Groups of odd texts alone, odd ones among others at all places, and others alone."""
    path = tmp_path_factory.mktemp("odd")
    odd = [x for x in ODD if "\x0b" not in x]  # SQL's fingerprints have less white space
    rows = [(200 * i, x, "en", "lone", len(x)) for i, x in enumerate(odd)]
    for i in range(180):
        x = odd[i % len(odd)] if i % 2 else f"Line {i} of it.\n" + "word " * (i * 7 % 150) + "end."
        rows.append((200 * (i // 20) + 1 + i % 20, x, "de" if i % 3 else "en", f"s{i % 2}", len(x)))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    return str(path)


def equal(spark, folder, name):
    got = entry.queries()[name](spark, folder)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 20


def test_sealed_texts_are_blocks(spark):
    plain = ["a", "a\nb", " a\n b ", "x ``` y"]
    rows = spark.createDataFrame([(x,) for x in ODD + plain], "text string").select("text", T.sealed(F.col("text")).alias("s"))
    for r in rows.select("text", "s", T.blocks(F.concat(F.lit("before\n\n"), "s", F.lit("\n\nafter"))).alias("b"), T.opened(F.col("s")).alias("o")).collect():
        assert r.b == ["before", r.text, "after"] and r.o == r.text and (r.s == r.text) == (r.text in plain)
    assert T.blocks_of("\ufdd1zz\n\n\ufdd14") == ["\ufdd1zz", "\ufdd14"]  # no sealed texts


def test_chunk_long_paragraphs(spark, folder):
    equal(spark, folder, "chunk_long_paragraphs")


@pytest.mark.parametrize("name", ["chunk_paragraphs", "chunk_windows", "chunked_dedup", "chunked_split", "text_blocks"])
def test_other_blocks(spark, folder, name):
    equal(spark, folder, name)
