"""Fingerprints that earlier builds have kept: a table in a folder, grown by one part a build."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import paths
from ..tables import cut
from . import curate
from . import messages as M

#: Bits of the sieve for each known fingerprint, its bits at most (8 MB), and places a fingerprint sets.
BITS_EACH, BITS_MOST, PLACES = 12, 1 << 26, 4
#: The column of fingerprints beside examples.
FINGERPRINT = "_fp"


def _places(fingerprint: Column, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(i), fingerprint), F.lit(bits)) for i in range(PLACES)]


def sieve(known: DataFrame, number: int):
    """A function of a fingerprint column: whether it may be among ``known``'s ``fp``; None where a sieve would be too full.

    A Bloom filter; its words are set by one aggregation, and ``BITS_MOST / 64`` of them at most reach the driver.
    """
    bits = 1 << max(6, (number * BITS_EACH - 1).bit_length())
    if bits > BITS_MOST:
        if number * PLACES > BITS_MOST // 2:
            return None
        bits = BITS_MOST
    place = known.select(F.explode(F.array(*_places(F.col("fp"), bits))).alias("p"))
    words = place.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("b")).toArrow()
    filled = np.zeros(bits // 64, np.int64)
    filled[words["w"].to_numpy()] = words["b"].to_numpy()
    sent = known.sparkSession.sparkContext.broadcast(filled.view(np.uint64))

    @F.pandas_udf("boolean")
    def hit(*at: pd.Series) -> pd.Series:
        met = np.ones(len(at[0]), dtype=bool)
        for column in at:
            p = column.to_numpy().astype(np.int64)
            met &= (sent.value[p >> 6] >> (p & 63).astype(np.uint64)) & np.uint64(1) == 1
        return pd.Series(met)

    return lambda fingerprint: hit(*_places(fingerprint, bits))


class Seen:
    """What earlier builds have kept, in ``folder``; ``key`` is that of ``curate.dedup``."""

    def __init__(self, folder: str, key: str = "all"):
        if key not in ("all", "user"):
            raise ValueError(f"unknown dedup key {key!r}")
        self.folder, self.roles = folder.rstrip("/"), ("user",) if key == "user" else M.ROLES

    def known(self, spark) -> DataFrame | None:
        return spark.read.schema("fp string").option("recursiveFileLookup", "true").parquet(self.folder) if paths.exists(spark, self.folder) else None

    def fresh(self, examples: DataFrame, fp: str | None = None) -> DataFrame:
        """``examples`` whose fingerprint no earlier build has kept. ``fp`` names a column that holds fingerprints, where
        these are at hand; then any columns may stand beside it.

        Rows that the sieve turns away are surely new. Of the others only fingerprints are joined with the table:
        what is new among them is little.
        """
        return self._fresh(examples, fp).drop(*([] if fp else [FINGERPRINT]))

    def _fresh(self, examples: DataFrame, fp: str | None = None) -> DataFrame:
        """``fresh``, with the column ``FINGERPRINT`` where none is given; ``examples`` are read once."""
        known, name = self.known(examples.sparkSession), fp or FINGERPRINT
        marked = examples if fp else examples.withColumn(FINGERPRINT, M.fingerprint(F.col("messages"), self.roles))
        number = 0 if known is None else known.count()
        if not number:
            return marked
        may = sieve(known, number)
        marked = cut(marked.withColumn("_may", F.lit(True) if may is None else may(F.col(name))), "fingerprinted")
        met = marked.where("_may").select(F.col(name).alias("_new")).distinct()
        new = cut(met.join(known, F.col("_new") == F.col("fp"), "left_anti"), "new")
        doubtful = marked.where("_may").join(new, F.col(name).eqNullSafe(F.col("_new")), "left_semi")
        return marked.where(~F.col("_may")).unionByName(doubtful).drop("_may")

    def ending(self, steps: list[curate.Step]) -> list[curate.Step]:
        """``steps`` and the one that leaves out what is known; what they return has the column ``FINGERPRINT``.

        A dedup by the same key, after which rows are only left out, hands its fingerprints on.
        """
        steps, at, fp = list(steps), len(steps) - 1, None
        while at >= 0 and getattr(steps[at][1], "filters", False):
            at -= 1
        if at >= 0 and steps[at][1] is curate.dedup and self.roles == M.ROLES:
            fp = FINGERPRINT
            steps[at] = (steps[at][0], curate.one_pass(lambda df: curate.dedup(df, fp=fp)))
        return [*steps, ("unseen", curate.one_pass(lambda df: self._fresh(df, fp)))]

    def remember(self, examples: DataFrame, fp: str | None = None) -> None:
        """Add the fingerprints of ``examples`` as one part, whole or not at all: it is written aside and then moved."""
        spark = examples.sparkSession
        part, made = uuid.uuid4().hex, M.fingerprint(F.col("messages"), self.roles) if fp is None else F.col(fp)
        aside = f"{self.folder}.writing-{part}"
        examples.select(made.alias("fp")).distinct().write.parquet(aside)
        paths.move(spark, aside, f"{self.folder}/part-{part}")
