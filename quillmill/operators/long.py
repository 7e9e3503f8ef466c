"""Blocks and packed chunks of documents of any length, from rows of lines.

A document here is rows (seq, source, line_no, line), so its lines may lie in any number of tasks. What a line
means depends on all lines before it: whether a fence is open, where a chunk began. Each range of
``RANGE`` rows tells what it does to the state that it begins in, and these are composed:

* fences and block numbers are sums, so ranges add up their own and take over the sums of those before;
* packing is greedy, so every block points to the one that would begin the next chunk. Within a range
  the pointers are followed in one task, from each block that can be the range's first chunk; over ranges, of which
  there are few, paths are doubled. Chunks are those of ``chunk.paragraphs`` and ``chunk.windows``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.counters import APPROX, Counter
from ..tables import cut, discard
from .generate import section_examples

#: Rows of a range, and what is summed before in a bucket of the search for pointers, at least.
RANGE = 10_000
WIDE = 1 << 20


def _summed(rows: DataFrame, at: str, **columns: Column) -> DataFrame:
    """``rows`` with each column's sum over the document up to and with the row, and as ``<name>_all`` over all of it.

    Rows are in order of ``at``. Sums are taken within ranges, and the totals of ranges, one row each, from
    range to range; a document of any length fills no task. Where rows have ``_r``, their range, it stays: rows that
    lie together by it are not moved again.
    """
    kept = "_r" in rows.columns
    made = (rows if kept else rows.withColumn("_r", F.floor(F.col(at) / RANGE))).withColumns({f"_{n}": c.cast("long") for n, c in columns.items()})
    place = Window.partitionBy("seq", "_r").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("seq")
    before = whole.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    totals = made.groupBy("seq", "_r").agg(*(F.sum(f"_{n}").alias(f"_{n}") for n in columns))
    totals = totals.select("seq", "_r", *(F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}_before") for n in columns), *(F.sum(f"_{n}").over(whole).alias(f"{n}_all") for n in columns))
    own = made.withColumns({f"_{n}": F.sum(f"_{n}").over(place) for n in columns}).join(totals, ["seq", "_r"])
    return own.withColumns({n: F.col(f"_{n}") + F.col(f"_{n}_before") for n in columns}).drop(*([] if kept else ["_r"]), *(f"_{n}" for n in columns), *(f"_{n}_before" for n in columns))


def _fenced(lines: DataFrame) -> DataFrame:
    """(seq, source, n, line, _r, blank, titled, fence, fences): lines, whether each is blank, looks like a heading or is a
    fence, and fences up to it.

    What a line is alone is told before lines are moved, so that sums over ranges move no text; the text itself moves once.
    """
    line = F.coalesce(F.col("line"), F.lit(""))
    told = cut(lines.select("seq", "source", F.col("line_no").cast("long").alias("n"), line.alias("line")), "lines")
    bare = T.lstrip(F.col("line"))
    told = told.withColumns({
        "_r": F.floor(F.col("n") / RANGE), "blank": bare == "", "fence": (bare.startswith("```") | bare.startswith("~~~")).cast("int"),
        "titled": F.col("line").startswith("#") & F.col("line").rlike(rf"^#{{1,6}}[{T.SPACES}]+"),
    })
    return _summed(told, "n", fences=F.col("fence")).drop("fences_all")


def sections(lines: DataFrame) -> DataFrame:
    """(seq, source, sub, level, title, body, path): the sections that ``text.headed`` finds in the whole text.

    A heading stays open until one of its level or a smaller one comes. So what is open above a heading are the
    latest headings of each smaller level, if none of a still smaller level came after; the latest of each level are
    maxima of places, which ranges take over from those before.
    """
    told = _fenced(lines)
    heading = ((F.col("fences") - F.col("fence")) % 2 == 0) & F.col("titled")
    told = cut(_summed(told.withColumn("head", heading.cast("int")), "n", k=F.col("head")).where("k > 0").select("seq", "source", "n", "line", "head", "k"), "headed")
    heads = told.where("head = 1").select("seq", "source", "k", F.length(F.regexp_extract("line", r"^(#{1,6})", 1)).alias("level"), F.regexp_extract("line", rf"^#{{1,6}}[{T.SPACES}]+(.+?)[{T.SPACES}]*#*[{T.SPACES}]*$", 1).alias("title"))
    levels = range(1, 7)
    heads = heads.withColumn("_r", F.floor(F.col("k") / RANGE)).withColumns({f"at{j}": F.when(F.col("level") == j, F.struct("k", "title")) for j in levels})
    before = Window.partitionBy("seq").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    place = Window.partitionBy("seq", "_r").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    ranges = heads.groupBy("seq", "_r").agg(*(F.max(f"at{j}").alias(f"at{j}") for j in levels))
    ranges = ranges.select("seq", "_r", *(F.max(f"at{j}").over(before).alias(f"old{j}") for j in levels))
    heads = heads.withColumns({f"at{j}": F.max(f"at{j}").over(place) for j in levels}).join(ranges, ["seq", "_r"])
    latest = F.array(*(F.struct(F.lit(j).alias("level"), F.greatest(f"at{j}", f"old{j}").alias("at")) for j in levels))
    above = F.filter("latest", lambda x: (x["level"] < F.col("level")) & x["at"].isNotNull())
    open_ = F.filter("above", lambda x: ~F.exists("above", lambda y: (y["level"] < x["level"]) & (y["at"]["k"] > x["at"]["k"])))
    path = F.array_append(F.transform(open_, lambda x: x["at"]["title"]), F.col("title"))
    heads = heads.withColumn("latest", latest).withColumn("above", above).select("seq", "source", "k", "level", "title", path.alias("path"))
    rows = F.sort_array(F.collect_list(F.struct("n", "line")))
    bodies = told.groupBy("seq", "k").agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("text"))
    body = T.strip(F.regexp_replace("text", r"^[^\n]*\n?", ""))
    name = F.concat("source", F.lit("#0")).alias("source")  # of the whole document, as ``generate.ref`` names it
    return heads.join(bodies, ["seq", "k"]).select("seq", name, (F.col("k") - 1).alias("sub"), "level", "title", body.alias("body"), "path")


def markdown_sections(lines: DataFrame, **options) -> DataFrame:
    """The examples of ``generate.markdown_sections``, of documents given as lines."""
    return section_examples(sections(lines), **options)


def blocks(lines: DataFrame) -> DataFrame:
    """(seq, source, at, text): the blocks that ``text.blocks`` finds in the whole text; ``at`` orders a document's.

    ``line_no`` numbers all lines of a document, blank ones too. Null lines are empty; a table without lines has no blocks.
    """
    told = _fenced(lines)
    outside = (F.col("fences") - F.col("fence")) % 2 == 0
    told = _summed(told.withColumn("gap", outside & F.col("blank")), "n", gaps=F.col("gap").cast("int"))
    rows = F.sort_array(F.collect_list(F.struct("n", "line")))
    text = F.regexp_replace(F.array_join(F.transform(rows, lambda r: r["line"]), "\n"), r"^\n+|\n+$", "")
    made = told.where("not gap").groupBy("seq", F.col("gaps").alias("at")).agg(F.first("source").alias("source"), text.alias("text"))
    return made.where(T.strip(F.col("text")) != "").select("seq", "source", "at", T.opened(F.col("text")).alias("text"))


def _ranges(walk: bool, reach: int, sep: int):
    """Of rows (seq, r, i, next, sum, size, entered) sorted by the first three: where paths leave ranges, or the chunks' starts."""

    def told(rows: pa.Table) -> pa.RecordBatch:
        seq, r, i, following, total, size, entered = (rows.column(c).to_numpy() for c in range(7))
        edge = np.flatnonzero(np.concatenate([[True], (seq[1:] != seq[:-1]) | (r[1:] != r[:-1]), [True]]))
        out_seq, out_i, out_to = [], [], []
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            first = int(i[a])
            to = (following[a:b] - first).tolist()
            if walk:
                at = int(np.flatnonzero(entered[a:b])[0]) if entered[a:b].any() else b - a
                while at < b - a:
                    out_seq.append(seq[a]), out_i.append(first + at), out_to.append(0)
                    at = to[at]
                continue
            for at in range(b - a - 1, -1, -1):
                if to[at] < b - a:
                    to[at] = to[to[at]]
            near = np.flatnonzero(total[a:b] - size[a:b] <= total[a] - size[a] + sep + reach)
            for at in near.tolist():
                out_seq.append(seq[a]), out_i.append(first + at), out_to.append(first + to[at])
        return pa.RecordBatch.from_arrays([pa.array(out_seq, pa.int64()), pa.array(out_i, pa.int64()), pa.array(out_to, pa.int64())], names=["seq", "i", "to"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            part = pa.Table.from_batches([batch])
            held = part if held is None else pa.concat_tables([held, part])
            seq, r = held.column(0).to_numpy(), held.column(1).to_numpy()
            new = np.flatnonzero((seq[1:] != seq[:-1]) | (r[1:] != r[:-1])) + 1
            if len(new):  # the last range may go on
                yield told(held.slice(0, int(new[-1])))
                held = held.slice(int(new[-1]))
        if held is not None and held.num_rows:
            yield told(held)

    return run


def _entries(exits: DataFrame) -> DataFrame:
    """(seq, i): the blocks at which the path from each document's first block enters ranges."""
    marks, jump = exits.where("i = 0").select("seq", "i"), exits
    number = marks.count()
    while True:
        met = marks.join(jump, ["seq", "i"]).select("seq", F.col("to").alias("i")).join(exits.select("seq", "i"), ["seq", "i"])
        marks = cut(marks.union(met).distinct(), "marks")
        if (more := marks.count()) == number:
            return marks
        number = more
        far = jump.select("seq", F.col("i").alias("to"), F.col("to").alias("far"))
        jump = cut(jump.join(far, ["seq", "to"], "left").select("seq", "i", F.coalesce("far", "to").alias("to")), "jump")


def _packed(lines: DataFrame, measure: Callable[[Column], Column], separator: int, most: int, least: int) -> DataFrame:
    if most <= 0:
        raise ValueError("the largest size must be positive")
    found = cut(blocks(lines).withColumn("size", measure(F.col("text")).cast("long")), "blocks")
    sums = _summed(found.select("seq", "at", "size"), "at", i=F.lit(1), sum=F.col("size") + separator)
    sums = cut(sums.select("seq", "at", "size", (F.col("i") - 1).alias("i"), F.col("i_all").alias("n"), "sum"), "sums")
    # The last block whose sum stays within what a chunk that begins here may hold.
    here = sums.select("seq", F.col("sum").alias("v"), F.col("i").alias("j"), F.lit(None).cast("long").alias("s"))
    asks = sums.select("seq", (F.col("sum") - F.col("size") + most).alias("v"), F.lit(None).cast("long").alias("j"), F.col("i").alias("s"))
    both = here.union(asks).withColumn("b", F.floor(F.col("v") / max(WIDE, 4 * most)))
    ends = here.withColumn("b", F.floor(F.col("v") / max(WIDE, 4 * most))).groupBy("seq", "b").agg(F.max("j").alias("end"))
    ends = both.select("seq", "b").distinct().join(ends, ["seq", "b"], "left")
    ends = ends.select("seq", "b", F.max("end").over(Window.partitionBy("seq").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)).alias("end"))
    order = Window.partitionBy("seq", "b").orderBy("v", F.col("j").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    found_at = both.withColumn("j", F.max("j").over(order)).where("s is not null").join(ends, ["seq", "b"])
    pointers = found_at.select("seq", F.col("s").alias("i"), (F.greatest("s", F.coalesce("j", "end", "s")) + 1).alias("next"))
    pointers = sums.join(pointers, ["seq", "i"]).select("seq", F.floor(F.col("i") / RANGE).alias("r"), "i", "next", "sum", "size", (F.col("i") == 0).alias("entered"))
    pointers = cut(pointers, "pointers")

    def by_range(rows: DataFrame) -> DataFrame:
        return rows.repartition("seq", "r").sortWithinPartitions("seq", "r", "i")

    kinds = "seq long, i long, to long"
    if pointers.where("r > 0").limit(1).count():
        exits = cut(by_range(pointers).mapInArrow(_ranges(False, most, separator), kinds), "exits")
        entered = _entries(exits).withColumn("met", F.lit(True))
        pointers = pointers.join(entered, ["seq", "i"], "left").select("seq", "r", "i", "next", "sum", "size", F.coalesce("met", F.lit(False)).alias("entered"))
    starts = by_range(pointers).mapInArrow(_ranges(True, most, separator), kinds).select("seq", "i", F.lit(1).alias("start"))
    marked = cut(sums.join(starts, ["seq", "i"], "left"), "starts")
    numbered = _summed(marked, "i", chunk=F.coalesce("start", F.lit(0))).select("seq", "at", "i", "n", (F.col("chunk") - 1).alias("index"))
    rows = F.sort_array(F.collect_list(F.struct("i", "text")))
    made = found.join(numbered, ["seq", "at"]).groupBy("seq", "index").agg(
        F.first("source").alias("source"), F.array_join(F.transform(rows, lambda r: r["text"]), "\n\n").alias("text"),
        (F.sum("size") + separator * (F.count(F.lit(1)) - 1)).alias("total"), (F.max("i") == F.max("n") - 1).alias("last"),
    )
    kept = made.where(~F.col("last") | (F.col("total") >= min(least, most)) | (F.col("index") == 0))
    out = cut(kept.select("seq", "source", "text", F.lit("").alias("sha256"), F.col("index").cast("int").alias("index")), "chunks")
    for table in (found, sums, pointers, marked):
        discard(table)
    return out


def paragraphs(lines: DataFrame, max_chars: int = 3000, min_chars: int = 200) -> DataFrame:
    """The chunks of ``chunk.paragraphs``, of documents given as lines."""
    return _packed(lines, F.length, 2, max_chars, min_chars)


def windows(lines: DataFrame, max_tokens: int = 800, min_tokens: int = 50, counter: Counter = APPROX) -> DataFrame:
    """The chunks of ``chunk.windows``, of documents given as lines."""
    return _packed(lines, counter.count, 1, max_tokens, min_tokens)
