"""Readers: documents, JSONL records and tables, plain or compressed."""

from __future__ import annotations

import bz2
import gzip
import hashlib
import lzma
import re
import uuid
from collections.abc import Iterable

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import FormatError, ValidationError
from ..functions import text as T
from ..operators import formats as R
from ..tables import cut, shared_dir
from . import archives, folders, paths, ranges

DOCUMENTS = "seq long, source string, text string, sha256 string, index int"
#: Archives that Spark's own line readers do not open.
_FOREIGN = r"(?i)\.(gzip|xz|lzma)$"
#: Splits of a dataset whose line numbers are broadcast (some 200 bytes each).
BROADCAST_SPLITS = 100_000
#: Files of a dataset whose formats are broadcast.
BROADCAST_FILES = 100_000
_OPEN = {"gz": gzip.decompress, "gzip": gzip.decompress, "xz": lzma.decompress, "lzma": lzma.decompress, "bz2": bz2.decompress}


def _text(path: str, content: bytes) -> str:
    suffix = path.rpartition(".")[2].lower()
    try:
        raw = _OPEN[suffix](content) if suffix in _OPEN else content
        return raw.decode("utf-8-sig")
    except Exception as e:
        raise FormatError(f"{path}: cannot be read as UTF-8 text ({e})") from e


def _decoded(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
    for rows in batches:
        yield rows.assign(text=[_text(*x) for x in zip(rows["path"], rows["content"], strict=True)]).drop(columns="content")


def _opened(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
    """Rows (seq, source) with the text of the file ``source`` and its SHA-256, in batches of bounded size."""
    for rows in batches:
        held, size = [], 0
        for seq, path in zip(rows["seq"], rows["source"], strict=True):
            content = folders.contents(path)
            held.append((seq, path, _text(path, content), hashlib.sha256(content).hexdigest(), 0))
            size += len(content)
            if size >= folders.BYTES or len(held) >= folders.ROWS:
                yield pd.DataFrame(held, columns=["seq", "source", "text", "sha256", "index"])
                held, size = [], 0
        if held:
            yield pd.DataFrame(held, columns=["seq", "source", "text", "sha256", "index"])


def _plain(path):
    return F.regexp_replace(path, "^file:/+", "/")


def _files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of a file, a folder (recursive) or a glob; content is read only where it is used."""
    wanted = paths.expanded(spark, path)
    if not wanted:
        raise FileNotFoundError(path)
    try:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(wanted)
    except AnalysisException as e:
        raise FileNotFoundError(path) from e
    return found.select(_plain("path").alias("path"), "content")


def read_documents(spark: SparkSession, sources) -> DataFrame:
    """Documents of paths, folders, globs and DataFrames with a ``text`` column, in the order given.

    Paths are read once however often they are named. ``sha256`` is of the bytes on disk. Bad
    archives and bad UTF-8 raise FormatError. ``seq`` numbers documents from 0. Files of folders are
    numbered by their names and read after that.
    """
    items = [sources] if isinstance(sources, (str, DataFrame)) or not isinstance(sources, Iterable) else list(sources)
    parts, later = [], False
    for i, item in enumerate(items):
        if isinstance(item, DataFrame):
            names = item.columns
            order = F.col("seq").cast("string") if "seq" in names else F.monotonically_increasing_id().cast("string")
            parts.append(item.select(
                F.lit(i).alias("_item"), F.lpad(order, 20, "0").alias("_order"), (F.col("source") if "source" in names else F.lit("<string>")).alias("source"), F.col("text").cast("string").alias("text"),
                (F.col("sha256") if "sha256" in names else F.lit("")).alias("sha256"), (F.col("index") if "index" in names else F.lit(0)).cast("int").alias("index"), F.lit(False).alias("_file"), F.lit(False).alias("_later"),
            ))
        elif folder := folders.address(str(item)):
            found = folders.listed(spark, folder)
            if not found.limit(1).count():
                raise FileNotFoundError(str(item))
            nothing, later = F.lit(None).cast("string"), True
            parts.append(found.select(F.lit(i).alias("_item"), F.col("path").alias("_order"), F.col("path").alias("source"), nothing.alias("text"), nothing.alias("sha256"), F.lit(0).alias("index"), F.lit(True).alias("_file"), F.lit(True).alias("_later")))
        else:
            files = _files(spark, str(item))
            if not files.select("path").limit(1).count():
                raise FileNotFoundError(str(item))
            texts = files.select("path", "content", F.sha2("content", 256).alias("sha256")).mapInPandas(_decoded, "path string, sha256 string, text string")
            parts.append(texts.select(F.lit(i).alias("_item"), F.col("path").alias("_order"), F.col("path").alias("source"), "text", "sha256", F.lit(0).alias("index"), F.lit(True).alias("_file"), F.lit(False).alias("_later")))
    if not parts:
        return spark.createDataFrame([], DOCUMENTS)
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    first = F.row_number().over(Window.partitionBy("_file", "source").orderBy("_item"))
    whole = whole.where(~F.col("_file")).union(whole.where("_file").withColumn("_n", first).where("_n = 1").drop("_n"))
    whole = numbered(whole, ["_item", "_order"])
    rows = whole.where("not _later").select("seq", "source", "text", "sha256", "index")
    if not later:
        return rows
    names = whole.where("_later").select("seq", "source")
    read = names.repartition(-(-names.count() // folders.EACH) or 1).mapInPandas(_opened, DOCUMENTS)
    return rows.union(_cut_text(read, "documents")) if len(parts) > 1 else _cut_text(read, "documents")


def numbered(df: DataFrame, order: list[str], name: str = "seq") -> DataFrame:
    """A dense number in a total order: partitions are sorted by range and shifted by the sizes before."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id())
    ranged = cut(ranged.withColumn("_i", F.monotonically_increasing_id() - F.col("_p").cast("long") * F.lit(2**33)), "numbered")
    sizes = ranged.groupBy("_p").count().withColumn("_before", F.coalesce(F.sum("count").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return ranged.join(F.broadcast(sizes.select("_p", "_before")), "_p").withColumn(name, F.col("_i") + F.col("_before")).drop("_p", "_i", "_before")


def _retold(e: Exception) -> None:
    """What a job raises carries the message of the task."""
    if told := re.search(r"([^\s\]]+): cannot be read as UTF-8 text", str(e)):
        raise FormatError(told[0]) from e


def _cut_text(df: DataFrame, name: str) -> DataFrame:
    """``cut``, with text that is no UTF-8 told as such."""
    try:
        return cut(df, name)
    except Exception as e:
        _retold(e)
        raise


def _lines(spark: SparkSession, wanted: list[str], foreign: list[str]) -> DataFrame:
    """(path, line_no, raw) of all lines of some files, those that Spark opens itself read in splits.

    Each split numbers its lines, and the counts of the splits before it are added; so it is with
    the blocks of archives, which come through a data source of their own.
    """
    rows = None
    if wanted:
        read = spark.read.option("recursiveFileLookup", "true").text(wanted)
        rows = read.select(_plain("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("i"), "value")
    if foreign:
        more = archives.archive_lines(spark, foreign).withColumn("value", F.col("value").cast("string")).select("path", "split", "i", "value")
        rows = more if rows is None else rows.unionByName(more)
    bad = F.raise_error(F.concat("path", F.lit(": cannot be read as UTF-8 text")))
    rows = _cut_text(rows.withColumn("value", F.when(F.is_valid_utf8("value"), F.col("value")).otherwise(bad.cast("string"))), "lines")
    sizes = rows.groupBy("path", "split").agg(F.min("i").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1))
    starts = cut(sizes.select("path", "split", (F.coalesce(before, F.lit(0)) - F.col("first") + 1).alias("shift")), "splits")
    starts = F.broadcast(starts) if starts.count() <= BROADCAST_SPLITS else starts
    return rows.join(starts, ["path", "split"]).select("path", (F.col("i") + F.col("shift")).alias("line_no"), F.col("value").alias("raw"))


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, raw): lines that are not blank, numbered from 1 with blank ones counted.

    Plain files are read in splits, .xz files by their blocks, other archives by one task each; none is
    held as a whole.
    """
    wanted, names = paths.expanded(spark, path), _files(spark, path).select("path")
    foreign = sorted(r[0] for r in names.where(F.col("path").rlike(_FOREIGN)).collect())  # names of archives, not what they hold
    if foreign:
        wanted = sorted(r[0] for r in names.where(~F.col("path").rlike(_FOREIGN)).collect())
    rows = _lines(spark, wanted, foreign)
    return rows.select("path", "line_no", T.strip(F.col("raw")).alias("raw")).where("raw <> ''")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(seq, source, line_no, line): documents of any length as rows of lines, for ``operators.long``.

    A file is a document; ``seq`` follows the order of paths. Lines end as ``text.lines`` ends them, and
    ``line_no`` is dense over all files.
    """
    wanted, names = paths.expanded(spark, path), _files(spark, path).select("path")
    foreign = sorted(r[0] for r in names.where(F.col("path").rlike(_FOREIGN)).collect())
    rows = _lines(spark, sorted(r[0] for r in names.where(~F.col("path").rlike(_FOREIGN)).collect()) if foreign else wanted, foreign)
    rows = rows.select("path", "line_no", F.posexplode(F.split(F.when(F.col("line_no") == 1, F.regexp_replace("raw", "^\ufeff", "")).otherwise(F.col("raw")), T.LINE_END)).alias("sub", "line"))
    rows = numbered(rows, ["path", "line_no", "sub"], "n")
    order = rows.select("path").distinct().select("path", (F.row_number().over(Window.orderBy("path")) - 1).cast("long").alias("seq"))
    return rows.join(F.broadcast(order), "path").select("seq", F.col("path").alias("source"), (F.col("n") + 1).alias("line_no"), "line")


def parsed(lines: DataFrame) -> DataFrame:
    """Lines with ``rec`` (null for bad JSON) and ``own``, the format that the keys show."""
    return lines.withColumn("rec", F.try_parse_json("raw")).withColumn("own", R.detect(F.col("rec")))


def pinned(lines: DataFrame, fmt: str = "auto") -> DataFrame:
    """Records with ``fmt`` and ``issues``: a file's first valid record's format holds for all later ones of the file.

    Up to that record each line is judged by its own keys. Lines without a ``path`` are one file.
    """
    rows = parsed(lines)
    if fmt != "auto":
        return rows.withColumn("fmt", F.lit(R.get_format(fmt))).withColumn("issues", R.record_issues(F.col("rec"), F.col("fmt"))).drop("own")
    rows = rows.withColumn("issues", R.record_issues(F.col("rec"), F.col("own")))
    place = F.col("path") if "path" in lines.columns else F.lit("")
    pins = rows.where(F.size("issues") == 0).groupBy(place.alias("_file")).agg(F.min_by("own", "line_no").alias("_pin"), F.min("line_no").alias("_from"))
    pins = cut(pins, "pins")
    pins = F.broadcast(pins) if pins.count() <= BROADCAST_FILES else pins
    rows = rows.withColumn("_at", place)
    later = F.coalesce(F.col("line_no") > F.col("_from"), F.lit(False))
    rows = rows.join(pins, F.col("_at") == F.col("_file"), "left").withColumn("fmt", F.when(later, F.col("_pin")).otherwise(F.col("own"))).drop("own")
    return rows.withColumn("issues", F.when(later, R.record_issues(F.col("rec"), F.col("fmt"))).otherwise(F.col("issues"))).drop("_at", "_file", "_pin", "_from")


def read_examples(spark: SparkSession, path: str, input_format: str = "auto", on_invalid: str = "raise") -> DataFrame:
    """Examples of a JSONL dataset; the first bad line raises with path and number, or bad lines are skipped."""
    if on_invalid not in ("raise", "skip"):
        raise ValueError("on_invalid is 'raise' or 'skip'")
    rows = pinned(read_jsonl(spark, path), input_format)
    if on_invalid == "raise":
        bad = rows.where(F.size("issues") > 0).orderBy("path", "line_no").select("path", "line_no", "issues").limit(1).collect()
        if bad:
            raise ValidationError(f"{bad[0].path}:{bad[0].line_no}: {', '.join(sorted(set(bad[0].issues)))}", tuple(bad[0].issues))
    fine = rows.where(F.size("issues") == 0)
    # Files follow each other in the order of their paths; a listing of paths is small.
    order = rows.select("path").distinct().select("path", (F.row_number().over(Window.orderBy("path")) - 1).cast("long").alias("file"))
    fine = fine.join(F.broadcast(order), "path")
    seq = (F.col("file") * F.lit(2**40) + F.col("line_no")).alias("seq")
    return fine.select(seq, F.lit(0).alias("sub"), F.lit(None).cast("string").alias("source"), R.decode(F.col("rec"), F.col("fmt")).alias("messages"))


def rejected(spark: SparkSession, path: str, input_format: str = "auto") -> DataFrame:
    """(path, line_no, issues) of the lines that ``read_examples`` with ``on_invalid="skip"`` leaves out."""
    return pinned(read_jsonl(spark, path), input_format).where(F.size("issues") > 0).select("path", "line_no", "issues")


def _unpacked(spark: SparkSession, path: str) -> str:
    """``path``, or a folder of the shared place with the text of an archive that Spark does not open.

    One task writes it, line by line, so that the file's head stays its head.
    """
    if not re.search(_FOREIGN, path):
        return path
    folder = f"{shared_dir(spark).rstrip('/')}/quillmill/unpacked-{uuid.uuid4().hex}"
    lines = archives.archive_lines(spark, [path]).select(F.col("value").cast("string").alias("value"))
    bad = F.raise_error(F.lit(f"{path}: cannot be read as UTF-8 text")).cast("string")
    try:
        lines.coalesce(1).select(F.when(F.is_valid_utf8("value"), F.col("value")).otherwise(bad).alias("value")).write.text(folder)
    except Exception as e:
        _retold(e)
        raise
    return folder


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a CSV, JSONL or JSON file, plain or compressed. CSV cells are strings, missing ones
    empty; the separator is the commonest of , ; tab | in the head. JSON is an array of objects,
    or one under data, records, rows or items. Of the file only the head reaches the driver."""
    if not _files(spark, path).select("path").limit(1).count():
        raise FileNotFoundError(path)
    suffix = re.sub(r"\.(gz|gzip|xz|lzma|bz2)$", "", path.lower()).rpartition(".")[2]
    path = _unpacked(spark, path)
    lines = spark.read.text(path)
    head = next((r[0] for r in lines.where(F.trim("value") != "").limit(1).collect()), "")[:4096]
    if suffix == "csv" or (suffix not in ("json", "jsonl", "ndjson") and re.search("[,;\t]", head) and not head.lstrip().startswith(("{", "["))):
        separator = max(",;\t|", key=head.count)
        quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
        over = bool(lines.where(quotes % 2 == 1).limit(1).count())  # a cell goes on in the next line
        if over:
            return ranges.read_csv(spark, path, separator).na.fill("")
        return spark.read.csv(path, header=True, sep=separator, quote='"', escape='"', nullValue="\ufdd0", emptyValue="").na.fill("")
    if suffix in ("jsonl", "ndjson") or (suffix != "json" and head.lstrip().startswith("{")):
        records = read_jsonl(spark, path)
        bad = records.where(~F.coalesce(R.is_object(F.try_parse_json("raw")), F.lit(False))).agg(F.min("line_no")).first()[0]
        if bad is not None:
            raise FormatError(f"{path}:{bad}: a line must be a JSON object")
        return spark.read.json(path)
    rows = ranges.read_json_objects(spark, path, ("data", "records", "rows", "items"))
    names = sorted(r[0] for r in rows.select(F.explode(F.json_object_keys("value"))).distinct().collect())
    cells = rows.select(F.from_json("value", "map<string,string>").alias("m"))
    return cells.select(*(F.element_at("m", F.lit(n)).alias(n) for n in names))
