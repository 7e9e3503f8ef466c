"""Linear models fitted in one task from a bounded sample (numpy only)."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import cut


class Rows:
    """Sparse rows: feature numbers and values, row by row."""

    def __init__(self, lists: list[np.ndarray], values: list[np.ndarray] | None = None):
        self.start = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
        self.index = np.concatenate(lists).astype(np.int32) if lists else np.zeros(0, np.int32)
        self.value = np.concatenate(values).astype(np.float32) if values else np.ones(len(self.index), np.float32)
        self.row = np.repeat(np.arange(len(lists), dtype=np.int32), np.diff(self.start))

    def __len__(self) -> int:
        return len(self.start) - 1

    def take(self, rows: np.ndarray) -> Rows:
        parts = [slice(self.start[i], self.start[i + 1]) for i in rows]
        return Rows([self.index[p] for p in parts], [self.value[p] for p in parts])

    def dot(self, weight: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=self.value * weight[self.index], minlength=len(self))

    def transposed_dot(self, per_row: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.index, weights=self.value * per_row[self.row], minlength=size)


def hinge_by_dual_descent(rows: Rows, sign: np.ndarray, size: int, cost: float = 1.0, epochs: int = 20, seed: int = 7, balance: bool = True) -> tuple[np.ndarray, float]:
    """Weights and bias of an L2-regularised hinge-loss model, by dual coordinate descent.

    One dual variable a row, kept in [0, cost of its class]; each step solves for one of them
    exactly and updates the weights. ``balance`` gives both classes the same total cost.
    """
    weight, bias, alpha = np.zeros(size), 0.0, np.zeros(len(rows))
    share = {s: len(rows) / (2 * max(1, int((sign == s).sum()))) for s in (-1, 1)} if balance else {-1: 1.0, 1: 1.0}
    limit = np.array([cost * share[int(s)] for s in sign])
    norm = np.bincount(rows.row, weights=rows.value**2, minlength=len(rows)) + 1.0
    parts = [(rows.index[a:b], rows.value[a:b]) for a, b in zip(rows.start[:-1], rows.start[1:], strict=True)]
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            index, value = parts[i]
            slope = sign[i] * (value @ weight[index] + bias) - 1.0
            new = min(max(alpha[i] - slope / norm[i], 0.0), limit[i])
            step = (new - alpha[i]) * sign[i]
            if step:
                alpha[i] = new
                weight[index] += step * value
                bias += step
                moved = max(moved, abs(step) * norm[i] ** 0.5)
        if moved < 1e-3:
            break
    return weight, bias


def logistic_scale(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """(a, b) so that 1 / (1 + exp(-(a * margin + b))) fits labels 0 and 1 (smoothed targets)."""
    pos, neg = float(label.sum()), float(len(label) - label.sum())
    if not pos or not neg:
        return 1.0, 0.0
    target = np.where(label == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    spread = float(margin.std()) or 1.0
    x, a, b = margin / spread, 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = p * (1 - p) + 1e-9
        ga, gb = ((p - target) * x).sum() + 1e-3 * a, (p - target).sum()
        haa, hab, hbb = (w * x * x).sum() + 1e-3, (w * x).sum(), w.sum()
        det = haa * hbb - hab * hab
        if det <= 0:
            break
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        size = max(1.0, abs(da), abs(db))
        a, b = a - da / size, b - db / size
        if max(abs(da), abs(db)) < 1e-6:
            break
    return a / spread, b


#: Features of each label that a model learns from, at most: very long texts do not make the
#: sample's size unbounded.
FEATURES = 2_000_000


def bounded_sample(rows: DataFrame, key: str, label: str, limit: int) -> DataFrame:
    """At most ``limit`` rows of each label, those with the smallest hashes of the key.

    It needs only these two columns, is the same in every run, and can be broadcast: it has
    ``limit`` rows a label at most. Counts give each label a bound on its hashes that leaves a
    few more than ``limit`` rows (six deviations more, so that hardly ever one is missing); only
    these are sorted, so a hot label does not meet in one task.
    """
    rows = rows.where(F.col(key).isNotNull() & F.col(label).isNotNull())
    counts = rows.groupBy(F.col(label).alias("_label")).agg(F.count(F.lit(1)).alias("_rows"))
    place = (F.xxhash64(key) / 2.0**64 + 0.5)  # even over 0 to 1
    near = rows.join(F.broadcast(counts), rows[label] == F.col("_label")).where(place * F.col("_rows") < limit + 6 * limit**0.5 + 50)
    order = Window.partitionBy(label).orderBy(F.xxhash64(key), key)
    return near.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit).drop("_n", "_label", "_rows")


def _fitting(most: int):
    """Of rows (label, hash, doc_id, size, _row) in order, those that fit into what is left of their label's ``most``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: dict[str, int] = {}
        for batch in batches:
            kept = []
            for label, size, row in zip(*(batch.column(i).to_pylist() for i in (0, 3, 4)), strict=True):
                if size <= left.setdefault(label, most):
                    left[label] -= size
                    kept.append(row)
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int64())], names=["_row"])

    return run


def fitted_in_one_task(features: DataFrame, label: str, fit: Callable[[pa.Table], object], most: int = FEATURES) -> object:
    """What ``fit`` makes of a table of (doc_id, ``label``, features, ...) rows; None without rows.

    Of each label come rows in the order of their ids' hashes as long as ``most`` features are held; a row
    that no longer fits is left out, and smaller ones behind it still come. The table lives in one task and
    only the model, pickled, reaches the driver. ``features`` holds a bounded sample of rows.
    """
    features = cut(features.withColumn("_row", F.monotonically_increasing_id()), "features")
    sizes = features.select(F.col(label).cast("string").alias("label"), F.xxhash64("doc_id").alias("hash"), F.col("doc_id").cast("long").alias("doc_id"), F.size("features").cast("long").alias("size"), "_row")
    fitting = sizes.repartition(1).sortWithinPartitions("label", "hash", "doc_id", "size").mapInArrow(_fitting(most), "_row long")
    held = features.join(fitting, "_row", "left_semi").drop("_row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if got := [x for x in batches if x.num_rows]:
            rows = pa.Table.from_batches(got)
            rows = rows.take(pa.compute.sort_indices(rows.select(["doc_id", label]), [("doc_id", "ascending"), (label, "ascending")]))
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(rows))], pa.binary())], names=["model"])

    found = held.repartition(1).mapInArrow(run, "model binary").toArrow()["model"].to_pylist()
    return pickle.loads(found[0]) if found else None


def held_out(doc_id: str, parts: int, part: int):
    """Whether crc32 of the id's text falls in the part kept from learning; a null id does not."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % parts == part, F.lit(False))
