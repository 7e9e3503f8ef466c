"""Joins and groups with frequent keys.

A key that holds more than one row in ``SHARE`` is frequent; there are fewer than ``SHARE`` such
keys whatever the table's size, so they may be collected or broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARE = 1000


def join_unique(rows: DataFrame, unique: DataFrame, on: list[str], number: str) -> DataFrame:
    """``rows`` joined with ``unique``, which has each key once and, in ``number``, how many rows it has.

    Frequent keys are broadcast, so their rows stay where they are; the others are shuffled and none
    of them fills a task. Both should be cheap to read twice.
    """
    total = unique.agg(F.coalesce(F.sum(number), F.lit(0))).first()[0]
    often = unique.where(F.col(number) * SHARE > total)
    if not often.limit(1).count():
        return rows.join(unique, on)
    rest = unique.where(F.col(number) * SHARE <= total)
    keyed = F.broadcast(often.select(*on))
    return rows.join(F.broadcast(often), on).unionByName(rows.join(keyed, on, "left_anti").join(rest, on))
