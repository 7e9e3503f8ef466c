"""CSV records and JSON objects that do not end with lines, read by many tasks.

A file is read in splits. What a piece of it means depends on what stands before: whether a quote is
open, how deep braces are. So each piece first tells what it does to every state that it could begin
in; these are composed within a split, the compositions of splits (one row each) from split to
split, and then every piece knows the state that it begins in.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import FormatError
from ..tables import cut


def _place():
    return Window.partitionBy("path", "split").orderBy("i")


def _so_far():
    return _place().rowsBetween(Window.unboundedPreceding, 0)


def _earlier():
    return Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)


def pieces(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """(path, split, i, value) of a file's lines, or of its pieces between ``separator``; a written table."""
    read = spark.read.option("recursiveFileLookup", "true")
    read = (read if separator is None else read.option("lineSep", separator)).text(path)
    rows = read.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("i"), "value")
    return cut(rows, "pieces")


def _count(text: Column, sign: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit("")))


# --- CSV -------------------------------------------------------------------------------------


def _opens(line: Column, separator: str) -> Column:
    """Whether a quote is open behind ``line``, which begins outside of quotes: a cell is quoted from its first sign on."""
    begin = f"(^|{re.escape(separator)})\""
    rest = F.regexp_replace(line, rf'(?s){begin}(?:[^"]++|"")*+"', "$1")
    return rest.rlike(f"(?s){begin}").cast("int")


def _begins_open(lines: DataFrame, separator: str) -> DataFrame:
    """Lines with ``before`` and ``after``: 1 if a quote is open before or behind the line.

    What a line does is to keep the state, to turn it, or to set it. So the state is what was set last, turned
    as often as lines have turned it since.
    """
    quoted = F.col("value").contains('"')
    shut, open_ = _opens(F.col("value"), separator), _opens(F.concat(F.lit('"'), "value"), separator)
    told = lines.withColumn("shut", F.when(quoted, shut).otherwise(0)).withColumn("open", F.when(quoted, open_).otherwise(1))
    told = told.withColumn("turn", ((F.col("shut") == 1) & (F.col("open") == 0)).cast("int"))
    told = told.withColumn("turns", F.sum("turn").over(_so_far())).withColumn("set", F.when(F.col("shut") == F.col("open"), F.struct(F.col("i").alias("at"), F.col("shut").alias("to"), F.col("turns").alias("then"))))
    told = cut(told.withColumn("set", F.last("set", ignorenulls=True).over(_so_far())).select("path", "split", "i", "value", "turns", "set", "turn", "shut", "open"), "told")
    last = told.groupBy("path", "split").agg(F.max_by(F.struct("turns", "set"), "i").alias("x")).select("path", "split", "x.*")
    last = last.withColumn("all", F.sum("turns").over(_earlier()) + F.col("turns"))
    last = last.withColumn("all", F.coalesce("all", "turns")).withColumn("fixed", F.when(F.col("set").isNotNull(), F.struct(F.col("set")["to"].alias("to"), (F.col("all") - F.col("turns") + F.col("set")["then"]).alias("then"))))
    known = F.last("fixed", ignorenulls=True).over(_earlier())
    gone = F.coalesce(F.sum("turns").over(_earlier()), F.lit(0))
    start = last.select("path", "split", F.pmod(F.coalesce(known["to"], F.lit(0)) + gone - F.coalesce(known["then"], F.lit(0)), F.lit(2)).cast("int").alias("start"))
    met = told.join(F.broadcast(start), ["path", "split"])  # one row for each split of the files
    after = F.when(F.col("set").isNotNull(), F.pmod(F.col("set")["to"] + F.col("turns") - F.col("set")["then"], F.lit(2))).otherwise(F.pmod(F.col("start") + F.col("turns"), F.lit(2)))
    return met.withColumn("after", after.cast("int")).withColumn("before", F.coalesce(F.lag("after").over(_place()), F.col("start"))).select("path", "split", "i", "value", "before", "after")


def csv_records(lines: DataFrame, separator: str) -> DataFrame:
    """(split, i, value): the records of ``pieces``, each where it begins, lines of one joined by a line end.

    Only records of several lines are shuffled. Blank lines between records are left out.
    """
    told = cut(_begins_open(lines, separator), "states")
    begins = F.col("before") == 0
    whole = told.where(begins & (F.col("after") == 0) & (F.trim("value") != "")).select("path", "split", "i", "value")
    mine = told.withColumn("head", F.last(F.when(begins, F.struct("split", "i")), ignorenulls=True).over(_so_far()))
    last = told.where(begins).groupBy("path", "split").agg(F.max(F.struct("split", "i")).alias("h"))
    splits = told.select("path", "split").distinct().join(last, ["path", "split"], "left")
    carried = splits.select("path", "split", F.last("h", ignorenulls=True).over(_earlier()).alias("carried"))
    parts = mine.join(F.broadcast(carried), ["path", "split"]).where((F.col("before") == 1) | (F.col("after") == 1))
    parts = parts.withColumn("head", F.coalesce("head", "carried"))
    rows = F.sort_array(F.collect_list(F.struct("split", "i", "value")))
    long = parts.groupBy("path", "head").agg(F.array_join(F.transform(rows, lambda r: r["value"]), "\n").alias("value"))
    return whole.unionByName(long.select("path", "head.split", "head.i", "value"))


def _names(header: str, separator: str) -> list[str]:
    """Column names of a head; empty ones and repeated ones are named after their place."""
    cells = next(csv.reader(header.split("\n"), delimiter=separator), [])
    times = [sum(c.lower() == x.lower() for x in cells) for c in cells]
    return [f"_c{i}" if not c else f"{c}{i}" if n > 1 else c for i, (c, n) in enumerate(zip(cells, times, strict=True))]


def read_csv(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """Rows of a CSV file whose cells go over lines, in its order; cells are strings, missing ones null."""
    records = cut(csv_records(pieces(spark, path), separator), "records")
    head = records.orderBy("path", "split", "i").limit(1).collect()
    if not head:
        return spark.createDataFrame([], "value string").select()
    names = _names(head[0]["value"].removeprefix("\ufeff"), separator)
    kinds = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    options = {"sep": separator, "quote": '"', "escape": '"', "nullValue": "\ufdd0", "emptyValue": ""}
    first = records.groupBy("path").agg(F.min(F.struct("split", "i")).alias("x")).select("path", "x.*")  # each file has its head
    ordered = records.join(first, ["path", "split", "i"], "left_anti").repartitionByRange("path", "split", "i").sortWithinPartitions("path", "split", "i")
    return ordered.select(F.from_csv("value", F.lit(kinds), options).alias("r")).select("r.*")


# --- JSON ------------------------------------------------------------------------------------

_TOKENS = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\]]', re.DOTALL)
_KEY = re.compile(r'("(?:[^"\\]|\\.)*")\s*:\s*\[\s*\Z', re.DOTALL)


def _first_of_arrays(wrapped: int):
    """(id, skeleton, key, value): what stands before the first object of an array, its key, and the object."""
    import json

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for number, text, ended in zip(rows["id"], rows["value"], rows["ended"], strict=True):
                braces, brackets, at = (0, 0, None) if number == 0 else (wrapped, 1, None)
                for token in _TOKENS.finditer(text) if ended else ():
                    sign = token[0]
                    if sign == "{" and (braces, brackets) == (wrapped, 1):
                        at = token.start()
                    braces += (sign == "{") - (sign == "}")
                    brackets += (sign == "[") - (sign == "]")
                before, value = (text, None) if at is None else (text[:at], text[at:])
                key = _KEY.search(before)
                out.append((number, before, json.loads(key[1], strict=False) if key else None, value))
            yield pd.DataFrame(out, columns=["id", "skeleton", "key", "value"])

    return run


def _elements(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """((id, value, ended), wrapped): the texts that end with each object of an array, and what is behind the last.

    Pieces end with braces. ``wrapped`` is 1 if the file is an object that holds arrays, 0 if it is an array.
    """
    rows = pieces(spark, path, "}")
    head = rows.orderBy("path", "split", "i").limit(1).collect()
    lead = head[0]["value"].lstrip("\ufeff \t\r\n")[:1] if head else ""
    wrapped = int(lead == "{")
    # Quotes that count, then the state of each piece, then what it does to the depth.
    bare = F.regexp_replace("value", r"(?s)\\.", "")
    quotes = rows.withColumn("q", _count(bare, '"')).withColumn("q", F.sum("q").over(_so_far()))
    totals = quotes.groupBy("path", "split").agg(F.max("q").alias("q"), F.max("i").alias("end"))
    last = totals.agg(F.max(F.struct("split", "end"))).first()[0]
    totals = totals.select("path", "split", F.coalesce(F.sum("q").over(_earlier()), F.lit(0)).alias("earlier"))
    inside = quotes.join(F.broadcast(totals), ["path", "split"]).withColumn("out", (F.col("q") + F.col("earlier")) % 2 == 0)
    own = _count(bare, '"')
    begins = (F.col("q") + F.col("earlier") - own) % 2
    solid = F.regexp_replace(F.when(begins == 1, F.concat(F.lit('"'), bare)).otherwise(bare), '"[^"]*(?:"|$)', "")
    at_end = (F.col("split") == F.lit(last["split"] if last else 0)) & (F.col("i") == F.lit(last["end"] if last else 0))
    moved = inside.withColumn("solid", solid).select(
        "path", "split", "i", "value", "out", (_count(F.col("solid"), "{") - _count(F.col("solid"), "}") - F.col("out").cast("int")).alias("braces"),
        (_count(F.col("solid"), "[") - _count(F.col("solid"), "]")).alias("brackets"), at_end.alias("final"),
    )
    moved = cut(moved.withColumn("braces", F.sum("braces").over(_so_far())).withColumn("brackets", F.sum("brackets").over(_so_far())), "moved")
    totals = moved.groupBy("path", "split").agg(F.max_by(F.struct("braces", "brackets"), "i").alias("x"))
    totals = totals.select("path", "split", *(F.coalesce(F.sum(f"x.{c}").over(_earlier()), F.lit(0)).alias(f"{c}0") for c in ("braces", "brackets")))
    ended = F.col("out") & (F.col("braces") + F.col("braces0") == wrapped) & (F.col("brackets") + F.col("brackets0") == 1)
    told = moved.join(F.broadcast(totals), ["path", "split"]).withColumn("ended", ended)
    # The last piece of a file ends with its brace only if there is one to close.
    told = told.withColumn("closed", ~F.col("final") | (F.col("braces") + F.col("braces0") >= 0))
    told = cut(told.withColumn("n", F.sum(F.col("ended").cast("long")).over(_so_far())).select("path", "split", "i", "value", "ended", "n", "closed"), "ended")
    totals = told.groupBy("path", "split").agg(F.max("n").alias("n"))
    totals = totals.select("path", "split", F.coalesce(F.sum("n").over(_earlier()), F.lit(0)).alias("earlier"))
    told = told.join(F.broadcast(totals), ["path", "split"]).withColumn("id", F.col("n") + F.col("earlier") - F.col("ended").cast("long"))
    told = told.withColumn("value", F.when(F.col("closed"), F.concat("value", F.lit("}"))).otherwise(F.col("value")))
    alone = F.coalesce(F.lag("ended").over(_place()), F.lit(False)) & F.col("ended")
    told = told.withColumn("alone", alone)
    joined = told.where("not alone").groupBy("path", "id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("split", "i", "value"))), lambda r: r["value"]), "").alias("value"), F.max("ended").alias("ended")
    )
    return cut(told.where("alone").select("id", "value", "ended").unionByName(joined.select("id", "value", "ended")), "elements"), wrapped


def read_json_objects(spark: SparkSession, path: str, keys: Iterable[str]) -> DataFrame:
    """(id, value): the objects of a JSON array, or of the one under the first of ``keys`` that holds one, as text in order.

    Everything but the objects must be JSON of its own, so that an array of other things is told.
    """
    elements, wrapped = _elements(spark, path)
    later = F.col("ended") & F.col("value").rlike(r"^\s*,\s*\{")
    firsts = cut(elements.where(~later).mapInPandas(_first_of_arrays(wrapped), "id long, skeleton string, key string, value string"), "firsts")
    parts = F.sort_array(F.collect_list(F.struct("id", "skeleton")))
    frame = firsts.agg(F.regexp_replace(F.array_join(F.transform(parts, lambda r: r["skeleton"]), ""), "^\ufeff", "").alias("s")).select(F.try_parse_json("s").alias("v"))
    kinds = frame.select(F.schema_of_variant("v").alias("whole"), *(F.schema_of_variant(F.try_variant_get("v", f"$.{k}", "variant")).alias(k) for k in keys)).first()
    if kinds["whole"] is None or not (wrapped or kinds["whole"] == "ARRAY<VOID>"):
        raise FormatError(f"{path}: not JSON, or an array that does not hold objects alone")
    begin, end = F.lit(0), F.lit(1 << 62)
    if wrapped:
        key = next((k for k in keys if (kinds[k] or "").startswith("ARRAY")), None)
        if key is None:
            raise FormatError(f"{path}: no array of objects under {', '.join(keys)}")
        if kinds[key] != "ARRAY<VOID>":
            raise FormatError(f"{path}: an array must hold objects alone")
        found = firsts.where(F.col("key") == key).agg(F.min("id")).first()[0]
        if found is None:
            return spark.createDataFrame([], "id long, value string")
        behind = firsts.where((F.col("id") > found) & F.col("value").isNotNull()).agg(F.min("id")).first()[0]
        begin, end = F.lit(found), F.lit(1 << 62 if behind is None else behind)
    rows = elements.where(later).select("id", F.regexp_replace("value", r"^\s*,\s*", "").alias("value")).unionByName(firsts.where("value is not null").select("id", "value"))
    rows = cut(rows.where((F.col("id") >= begin) & (F.col("id") < end)).repartitionByRange("id").sortWithinPartitions("id"), "objects")
    if rows.where(F.try_parse_json("value").isNull()).limit(1).count():
        raise FormatError(f"{path}: not JSON")
    return rows
