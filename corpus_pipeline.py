"""Corpus pipeline: five stages over ``documents``, each written and read again.

Language ID drops texts without a letter and names the language where none is given, the n-gram Jaccard join keeps one
document of each near-duplicate group, substring dedup cuts passages that repeat an earlier
document, decontamination drops documents that hold benchmark passages, and best-fit packing
turns what is left into sequences.

A stage decides on rows, not on ids: a row is known by its doc_id, which may be null, and its
text. Of repeated rows (one id, one text) one stays; rows of one id with different texts and
rows without an id are documents of their own, the latter after all others in order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmill.llm import decontam, jaccard, langid, packing, substrings
from quillmill.llm.queries import tokenizer_path
from quillmill.llm.scratch import cut

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def mark_of(text: str = "text"):
    return F.xxhash64(F.col(text).cast("string"))


def join_rows(docs: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """``docs`` joined with rows of (doc_id, mark), by id, null included, and text."""
    found = found.withColumnsRenamed({"doc_id": "_id", "mark": "_mark"})
    marked = docs.withColumn("_text_mark", mark_of())
    return marked.join(found, F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.col("_text_mark") == F.col("_mark")), how)


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a letter, with a null ``lang`` set to the language found.

    Only ``und`` goes (no text, or no letter in it); a low score drops nothing, since it does not
    tell a poor document from a good one. Rows with a null id stay, repeated rows too. Where no
    language can be learned, all texts are ``und`` and go. An empty table stays empty.
    """
    found = langid.identify_language(docs, carry=tuple(c for c in COLUMNS if c != "doc_id"))
    return found.where("lang_pred <> 'und' and text is not null").withColumn("lang", F.coalesce("lang", "lang_pred")).select(COLUMNS)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked ones: the smallest id's, a null id last.

    Of repeated rows one stays; texts without words link with nothing, so of equal ones under
    different ids all stay. An empty table stays empty.
    """
    found = jaccard.jaccard_rows(docs, shingle=5, threshold=(80, 100)).select("label", "doc_id", "mark")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")
    whole = found.where("label is not null").groupBy("label", "doc_id", "mark").agg(F.count(F.lit(1)).alias("times"))
    heads = whole.groupBy("label").agg(F.min_by(F.struct("doc_id", "mark", "times"), order).alias("head")).select("head.*")
    alone = found.where("label is null").select("doc_id", "mark").distinct().withColumn("times", F.lit(1).cast("long"))
    heads = cut(heads.union(alone), "heads", docs.count())
    once = join_rows(docs, heads.where("times = 1").drop("times"), "left_semi").select(COLUMNS)
    if not heads.where("times > 1").limit(1).count():
        return once
    repeated = join_rows(docs, heads.where("times > 1").drop("times"), "left_semi")
    number = F.row_number().over(Window.partitionBy("doc_id", "_text_mark").orderBy("lang", "source", "n_chars"))
    return once.union(repeated.withColumn("number", number).where("number = 1").select(COLUMNS))


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without words that repeat fifty words of an earlier document.

    A text that loses nothing stays as it is; one that loses all its words goes. Order is that of
    ids, then texts, null ids last. An empty table stays empty.
    """
    ids = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("doc_id is null or n > 1")
    rows = docs.withColumn("own_id", F.col("doc_id")).withColumn("whole", F.col("text"))
    if ids.limit(1).count():  # ids do not tell all rows apart: numbers in order of id and text do
        slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), mark_of().alias("mark")).distinct()
        slim = slim.orderBy(F.col("doc_id").isNull(), "doc_id", "mark")
        ranks = cut(slim.withColumn("rank", F.monotonically_increasing_id()), "ranks")
        rows = join_rows(rows, ranks, "inner").withColumn("doc_id", F.col("rank")).select(*COLUMNS, "own_id", "whole")
    stripped = substrings.remove_repeats(rows, depth=50).withColumn("doc_id", F.col("own_id"))
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("whole"))
    out = stripped.where("n_removed = 0 or n_words > n_removed").withColumn("text", text)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages, null ids included. An empty table stays empty."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontam.contaminated(docs, benchmark).select("doc_id", "mark").distinct()
    return join_rows(docs, found, "left_anti").select(COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of whole documents; null ids and repeated rows are packed like others. None of an empty table."""
    return packing.pack_documents(docs, tokenizer_path(), capacity=2048, end_id=0)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", keep_known_language),
    ("ngram_jaccard_join", keep_one_of_each_group),
    ("substring_dedup", cut_repeated_passages),
    ("benchmark_decontamination", drop_contaminated),
    ("best_fit_packing", pack_sequences),
]

#: Language ID is a trained model, which SQL cannot state; tests hold the stages against
#: brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
