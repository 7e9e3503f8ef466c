"""Chunkers: documents (seq, source, text, sha256, index) to documents with chunk numbers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.counters import APPROX, Counter


def no_chunks(docs: DataFrame) -> DataFrame:
    return docs.where(~T.is_blank(F.col("text")))


def _pack(docs: DataFrame, measure: Callable[[Column], Column], separator: int, most: int, least: int) -> DataFrame:
    """Pack blocks in order: a fold over block sizes keeps only where chunks end.

    A block that would overflow the chunk starts a new one; a full chunk ends at once; a block
    larger than ``most`` stands alone; a last chunk below ``least`` goes, unless it is the only one.
    """
    if most <= 0:
        raise ValueError("the largest size must be positive")
    made = docs.withColumn("_blocks", T.blocks(F.col("text"))).withColumn("_sizes", measure(F.col("_blocks")))
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("held"), F.lit(0).alias("size"), F.array().cast("array<int>").alias("ends"))

    def step(s: Column, size: Column) -> Column:
        over = (s["held"] > 0) & (s["size"] + size + separator > most)
        held = F.when(over, 0).otherwise(s["held"])
        total = F.when(held > 0, s["size"] + size + separator).otherwise(size)
        ends = F.when(over, F.array_append(s["ends"], s["at"])).otherwise(s["ends"])
        full = total >= most
        return F.struct(
            (s["at"] + 1).alias("at"), F.when(full, 0).otherwise(held + 1).alias("held"), F.when(full, 0).otherwise(total).alias("size"),
            F.when(full, F.array_append(ends, s["at"] + 1)).otherwise(ends).alias("ends"),
        )

    def finish(s: Column) -> Column:
        tail = (s["held"] > 0) & ((s["size"] >= least) | (F.size(s["ends"]) == 0))
        return F.when(tail, F.array_append(s["ends"], s["at"])).otherwise(s["ends"])

    made = made.withColumn("_ends", F.aggregate("_sizes", start, step, finish))

    def piece(end: Column, i: Column) -> Column:
        begin = F.when(i == 0, 0).otherwise(F.get("_ends", i - 1))
        return F.array_join(F.slice("_blocks", begin + 1, end - begin), "\n\n")

    chunks = F.posexplode(F.transform("_ends", piece)).alias("index", "text")
    return made.select(*(c for c in docs.columns if c not in ("text", "index")), chunks)


def paragraphs(docs: DataFrame, max_chars: int = 3000, min_chars: int = 200) -> DataFrame:
    return _pack(docs, lambda b: F.transform(b, F.length), 2, max_chars, min_chars)


def windows(docs: DataFrame, max_tokens: int = 800, min_tokens: int = 50, counter: Counter = APPROX) -> DataFrame:
    return _pack(docs, counter.sizes, 1, max_tokens, min_tokens)


CHUNKERS = {"none": no_chunks, "paragraphs": paragraphs, "window": windows}
