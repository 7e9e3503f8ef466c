"""Documents as rows of lines: the same blocks and chunks as from whole texts, over many ranges."""

import random

import pytest
from pyspark.sql import functions as F

from quillmill.functions import text as T
from quillmill.operators import chunk, generate, long
from quillmill.sources import readers

DOCS = "seq long, source string, text string, sha256 string, index int"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(6)
    made = ["", "\n\n  \n", "one", "a\n\nb", "```\nopen\n\n\nfence", "x\n```\n\ncode\n~~~\n\n after\n\n\n"]
    for n in (30, 300, 900):
        lines = []
        for _ in range(n):
            x = rng.random()
            lines.append("" if x < 0.3 else " \t" if x < 0.35 else "  ```py" if x < 0.38 else "~~~" if x < 0.4 else "w" * rng.choice([1, 5, 30, 80, 400]) + f" {x}")
        made.append("\n".join(lines))
    return made


@pytest.fixture
def both(spark, texts):
    docs = spark.createDataFrame([(i, f"s{i}", t, "", 0) for i, t in enumerate(texts)], DOCS)
    lines = docs.select("seq", "source", F.posexplode(F.split("text", "\n")).alias("n", "line")).select("seq", "source", (F.col("n") + 1).alias("line_no"), "line")
    return docs, lines.repartition(7)


def rows(df):
    return sorted((r.seq, r["index"], r.text) for r in df.collect())


@pytest.mark.parametrize("size", [7, 10_000])
def test_blocks_of_lines(both, monkeypatch, size):
    monkeypatch.setattr(long, "RANGE", size)
    docs, lines = both
    want = docs.select("seq", F.posexplode(T.blocks(F.col("text"))).alias("i", "text"))
    got = {}
    for r in long.blocks(lines).orderBy("seq", "at").collect():
        got.setdefault(r.seq, []).append(r.text)
    plain = {}
    for r in want.orderBy("seq", "i").collect():
        plain.setdefault(r.seq, []).append(r.text)
    assert got == plain and sum(map(len, got.values())) > 100


@pytest.mark.parametrize("size, most, least", [(5, 300, 80), (3, 40, 0), (10_000, 300, 80), (11, 1200, 1100)])
def test_chunks_of_lines(both, monkeypatch, size, most, least):
    """Ranges smaller than a chunk, chunks smaller than a block, and last chunks that are too small."""
    monkeypatch.setattr(long, "RANGE", size)
    monkeypatch.setattr(long, "WIDE", 500)
    docs, lines = both
    assert rows(long.paragraphs(lines, most, least)) == rows(chunk.paragraphs(docs, most, least))


def test_windows_of_lines(both, monkeypatch):
    monkeypatch.setattr(long, "RANGE", 9)
    docs, lines = both
    assert rows(long.windows(lines, 60, 20)) == rows(chunk.windows(docs, 60, 20))
    assert long.paragraphs(lines.where("false")).count() == 0


@pytest.mark.parametrize("size", [4, 10_000])
def test_sections_of_lines(spark, monkeypatch, size):
    """Headings of all levels in any order, fenced ones and odd ones; parents lie any number of ranges before."""
    monkeypatch.setattr(long, "RANGE", size)
    rng = random.Random(8)
    made = ["no heading\n\ntext", "# only\n", "## b ##\nx\n# a\n\n### c\ny\n#### \nz\n####### seven\n#none"]
    for n in (40, 200):
        lines = []
        for i in range(n):
            x = rng.random()
            lines.append("#" * rng.randint(1, 6) + f" title {i} " + "#" * rng.randint(0, 2) if x < 0.4 else "```" if x < 0.45 else "" if x < 0.6 else f"text {i} " * rng.randint(1, 9))
        made.append("\n".join(lines))
    docs = spark.createDataFrame([(i, f"s{i}", t, "", 0) for i, t in enumerate(made)], DOCS)
    lines = docs.select("seq", "source", F.posexplode(F.split("text", "\n")).alias("n", "line")).select("seq", "source", (F.col("n") + 1).alias("line_no"), "line").repartition(5)
    for options in ({"min_body_chars": 1}, {"min_body_chars": 30, "max_level": 3}):
        want, got = (sorted((r.seq, r.sub, r.source, str(r.messages)) for r in df.collect()) for df in (generate.markdown_sections(docs, **options), long.markdown_sections(lines, **options)))
        assert got == want and len(want) > 10


def test_lines_of_files(spark, tmp_path, texts):
    """Files of any line ends, read in splits and as archives, give the documents' chunks."""
    import lzma

    odd = "a\x0bb\r\n\r\n\x1c\ncode\u2028\n\n" + texts[-2]
    (tmp_path / "a.txt").write_bytes(("\ufeff" + odd).encode())
    (tmp_path / "b.txt.xz").write_bytes(lzma.compress(texts[-1].encode()))
    lines = readers.read_lines(spark, str(tmp_path))
    docs = spark.createDataFrame([(0, "a", odd, "", 0), (1, "b", texts[-1], "", 0)], DOCS)
    assert rows(long.paragraphs(lines, 300, 80)) == rows(chunk.paragraphs(docs, 300, 80))
