"""Exact dedup over streams, beyond the batch engine: the first row of each normal text in a time window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def dedup_stream(rows: DataFrame, text: str, at: str, late: str = "10 minutes") -> DataFrame:
    """State is kept for ``late`` beyond the newest time seen, so it stays bounded."""
    marked = rows.withWatermark(at, late).withColumn("fingerprint", F.sha2(T.normal_form(F.col(text)), 256))
    return marked.dropDuplicatesWithinWatermark(["fingerprint"])
