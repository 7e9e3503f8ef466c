"""Sharding by longest-processing-time scheduling.

Rows with equal texts form a group that must stay together. Groups, largest first, go to the
least-loaded shard through a heap. Groups of equal size are interchangeable, so the schedule
is made on a histogram of group sizes and gives each shard a number of groups of each size;
groups take their shard from their rank among groups of equal size. One task reads the sizes
in descending order and holds the loads alone; a row for each size goes back to the tables.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranks import with_rank
from .scratch import cut

#: Distinct group sizes up to this number are broadcast with their runs (some 200 bytes each).
BROADCAST_SIZES = 20_000


def dealt(loads: list[int], size: int, number: int) -> list[int]:
    """How many of ``number`` groups of one size each shard gets when the least-loaded one always
    takes the next, ties to the lower shard.

    A shard's loads before each further group are its load plus multiples of the size; taking
    turns means taking the ``number`` smallest of all these, so a level is searched for below
    which there are just as many.
    """
    def below(level: int) -> list[int]:
        return [max(0, -(-(level - x) // size)) for x in loads]

    low, high = min(loads), max(loads) + (number // len(loads) + 2) * size
    while high - low > 1:
        level = (low + high) // 2
        low, high = (level, high) if sum(below(level)) <= number else (low, level)
    given = below(low)
    rest = number - sum(given)
    for s, x in enumerate(loads):
        if rest and x <= low and (low - x) % size == 0:
            given[s] += 1
            rest -= 1
    return given


def schedule(histogram: Iterable[tuple[int, int]], shards: int) -> Iterator[tuple[int, int, int]]:
    """(size, first rank, shard) of runs of equal groups, by LPT with ties to the lower shard.

    ``histogram`` has (size, number of groups), largest size first, and is read once; the loads
    are all that is held. A heap gives the least-loaded shard; many groups of one size are dealt
    at once, as the heap would have dealt them.
    """
    heap = [(0, s) for s in range(shards)]
    for size, number in histogram:
        if number > 4 * shards:
            loads = [load for load, _ in sorted(heap, key=lambda x: x[1])]
            given = dealt(loads, size, number)
            heap = [(load + n * size, s) for s, (load, n) in enumerate(zip(loads, given, strict=True))]
            heapq.heapify(heap)
        else:
            given = [0] * shards
            for _ in range(number):
                load, shard = heap[0]
                heapq.heapreplace(heap, (load + size, shard))
                given[shard] += 1
        rank = 0
        for shard, n in enumerate(given):
            if n:
                yield size, rank, shard
                rank += n


def _scheduled(shards: int):
    """One row a size: where the runs of its groups begin, and their shards; from sizes in descending order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = ((s, n) for b in batches for s, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        runs = groupby(schedule(sizes, shards), key=lambda r: r[0])
        while some := [(size, *zip(*((rank, shard) for _, rank, shard in of), strict=True)) for size, of in islice(runs, 8192)]:
            cols = list(zip(*some, strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array([list(x) for x in cols[1]], pa.list_(pa.int64())), pa.array([list(x) for x in cols[2]], pa.list_(pa.int32()))],
                names=["bytes", "starts", "shards"],
            )

    return run


def shard_documents(docs: DataFrame, shards: int = 16, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row; law is ``bytes``.

    A row's size is its text's UTF-8 bytes plus 1; null texts have size 1, CRC 0, and form one
    group with the empty text. Slots are gapless from 0 in each shard; repeated rows have slots
    of their own, next to each other. A null id is returned as such; texts of any length count
    whole; an empty table gives an empty one; other columns are ignored. ``grown_shard`` is null
    under this law.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    spark = docs.sparkSession
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    base = cut(
        docs.select(F.col(doc_id).cast("long").alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), F.unhex(F.md5(body)).alias("digest")),
        "base",
    )
    groups = cut(base.groupBy("digest").agg(F.sum("size").alias("bytes")), "groups")
    sizes = groups.groupBy("bytes").agg(F.count(F.lit(1)).alias("n")).repartition(1).sortWithinPartitions(F.desc("bytes"))
    runs = cut(sizes.mapInArrow(_scheduled(shards), "bytes long, starts array<long>, shards array<int>"), "runs")
    runs = F.broadcast(runs) if runs.count() <= BROADCAST_SIZES else runs
    ranked = with_rank(groups, "bytes", ["digest"], "rank").select("digest", "bytes", "rank")
    shard = F.element_at("shards", F.size(F.filter("starts", lambda x: x <= F.col("rank"))))
    placed = cut(base.join(ranked.join(runs, "bytes").select("digest", shard.alias("shard")), "digest").drop("digest"), "placed")
    out = with_rank(placed, "shard", ["doc_id", "text_crc32", "size"], "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
