"""Whole texts go through Python once, whatever filters follow."""

import contextlib
import io

from pyspark.sql import functions as F

from quillmill.functions import text as T
from quillmill.operators import chunk, generate, long, near
from quillmill.tables import cut


def calls(df):
    with contextlib.redirect_stdout(io.StringIO()) as told:
        df.explain("simple")
    return sum(told.getvalue().count(f"{x}EvalPython") for x in ("Arrow", "Batch"))


def docs(spark, *texts):
    rows = [(i, "s", x, "", 0) for i, x in enumerate(texts)]
    return spark.createDataFrame(rows, "seq long, source string, text string, sha256 string, index int")


def test_signatures_are_made_once(spark):
    signed = docs(spark, "a").select("seq", near.signatures(5, 64)(F.col("text")).alias("sig")).where("sig is not null")
    assert calls(signed) == 1


def test_texts_are_read_once(spark):
    rows = docs(spark, "a")
    for made in (generate.continuation(rows), generate.faq_pairs(rows), generate.cloze(rows), chunk.paragraphs(rows)):
        assert calls(made) == 1


def test_noncharacters_stay(spark):
    """Marks that once parted texts are characters like others."""
    rows = docs(spark, "Q: what﷐ now?\nA: an answer of ﷐ enough letters", "x" * 120 + "﷐ in Madrid﷑ then")
    assert [tuple(m.content for m in r.messages) for r in generate.faq_pairs(rows).collect()] == [("what﷐ now?", "an answer of ﷐ enough letters")]
    assert [r.messages[1].content for r in generate.cloze(rows).collect()] == ["Madrid"]
    assert rows.where("seq = 1").select(T.blocks(F.col("text")).alias("b")).first().b == ["x" * 120 + "﷐ in Madrid﷑ then"]


def test_null_and_empty_texts(spark):
    got = docs(spark, None, "", "  \n").select("seq", T.blocks(F.col("text")).alias("b"), T.strip(F.col("text")).alias("s")).orderBy("seq").collect()
    assert [(r.b, r.s) for r in got] == [(None, None), ([], ""), ([], "")]


def test_lines_move_once_before_they_are_grouped(spark, monkeypatch):
    """Sums of fences and gaps go by one range; only flags and numbers are moved for their totals."""
    written = []
    monkeypatch.setattr(long, "cut", lambda df, name: written.append(name) or cut(df, name))
    rows = spark.createDataFrame([(1, "s", i, x) for i, x in enumerate(["a", "", "```", "", "~~~", " ", "b"])], "seq long, source string, line_no long, line string")
    found = long.blocks(rows)
    with contextlib.redirect_stdout(io.StringIO()) as told:
        found.explain("formatted")
    plan = told.getvalue()
    moved = [x for x in plan.split("\n\n") if ") Exchange" in x.split("\n")[0] and "line#" in x]
    assert len(moved) == 1 and written == ["lines"]
    assert [r.text for r in found.orderBy("at").collect()] == ["a", "```\n\n~~~", "b"]
