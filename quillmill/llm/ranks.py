"""Dense positions within groups of any size, without one task per group.

A plain ``row_number`` over a group's window puts the whole group in one task. Here rows
are first dealt to hashed buckets, numbered inside (group, bucket), and shifted by the
counts of the buckets before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Buckets of a group are as many as the session's shuffle partitions, but no fewer than this.
LEAST = 16


def with_rank(df: DataFrame, group: str, order: list[str], rank: str) -> DataFrame:
    """Add ``rank`` (long, gapless from 0 within ``group``), fixed by ``order`` and the number of buckets.

    ``df`` should be cheap to read twice (a written table). Rows equal in all of ``order``
    get neighbouring ranks in either order.
    """
    buckets = max(LEAST, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    made = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    counts = made.groupBy(group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(
        F.col(group).alias("_group"), F.col("_bucket").alias("_in"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"),
    )
    within = F.row_number().over(Window.partitionBy(group, "_bucket").orderBy(*order)) - 1
    numbered = made.withColumn("_within", within)
    return (
        numbered.join(base, numbered[group].eqNullSafe(base["_group"]) & (numbered["_bucket"] == base["_in"]))
        .withColumn(rank, (F.col("_within") + F.col("_base")).cast("long"))
        .drop("_bucket", "_within", "_group", "_in", "_base")
    )
