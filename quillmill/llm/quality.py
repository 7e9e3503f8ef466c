"""Quality classifier: naive Bayes support vectors.

N-gram indicators are scaled by their classes' log-count ratios, each text's vector is brought
to unit length, and a linear hinge-loss model is fitted by dual coordinate descent. A logistic
curve over margins of rows kept from the fit gives scores between 0 and 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytewords as bw
from . import hashed
from .linear import FEATURES, Rows, bounded_sample, fitted_in_one_task, held_out, hinge_by_dual_descent, logistic_scale

BITS = 18
#: Labelled rows of each class that the model learns from, at most.
SAMPLE = 3000


def _featured(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in bw.chunks(batch.column(2)):
                index, start = hashed.style_features(data, offsets, bits)
                lists = pa.ListArray.from_arrays(pa.array(start, pa.int32()), pa.array(index, pa.int32()))
                n = len(offsets) - 1
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, n), batch.column(1).slice(row, n), lists], names=["doc_id", "label", "features"])

    return run


def fit(sample: list[tuple[int, np.ndarray]], bits: int = BITS, alpha: float = 1.0) -> tuple[np.ndarray, np.ndarray, float, float, float]:
    """(ratios, weights, bias, a, b) from (label, feature numbers) rows.

    Without rows of both classes every text scores the share of label 1 (0.5 without rows).
    """
    size, label = 1 << bits, np.array([x[0] for x in sample])
    if len(set(label.tolist())) < 2:
        share = float(label.mean()) if len(label) else 0.5
        share = min(max(share, 1e-3), 1 - 1e-3)
        return np.zeros(size, np.float32), np.zeros(size, np.float32), 0.0, 1.0, float(np.log(share / (1 - share)))
    held = np.arange(len(sample)) % 5 == 0
    held = held if all(len(set(label[m].tolist())) == 2 for m in (held, ~held)) else np.zeros(len(sample), dtype=bool)
    rows = Rows([x[1] for x in sample])
    fitted = np.flatnonzero(~held)
    part = rows.take(fitted)
    counts = [alpha + part.transposed_dot((label[fitted] == c).astype(float), size) for c in (1, 0)]
    ratio = np.log(counts[0] / counts[0].sum()) - np.log(counts[1] / counts[1].sum())
    ratio[(counts[0] + counts[1]) < 2 * alpha + 2] = 0  # seen in a single text: no evidence

    def scaled(of: Rows) -> Rows:
        value = of.value * ratio[of.index]
        length = np.sqrt(np.bincount(of.row, weights=value**2, minlength=len(of)))
        of.value = value / np.maximum(length, 1e-9)[of.row]
        return of

    sign = np.where(label == 1, 1, -1)
    weight, bias = hinge_by_dual_descent(scaled(part), sign[fitted], size)
    check = scaled(rows.take(np.flatnonzero(held) if held.any() else fitted))
    a, b = logistic_scale(check.dot(weight) + bias, label[held] if held.any() else label[fitted])
    return ratio.astype(np.float32), (ratio * weight).astype(np.float32), bias, a, b


def _score(model, bits: int, cut: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio, weight, bias, a, b = model.value
        square = ratio.astype(np.float64) ** 2
        for batch in batches:
            for row, data, offsets in bw.chunks(batch.column(2)):
                index, start = hashed.style_features(data, offsets, bits)
                n = len(offsets) - 1
                of = np.repeat(np.arange(n), np.diff(start))
                length = np.sqrt(np.bincount(of, weights=square[index], minlength=n))
                margin = np.bincount(of, weights=weight[index], minlength=n) / np.maximum(length, 1e-9) + bias
                score = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, n), batch.column(1).slice(row, n), pa.array(score), pa.array((score >= cut).astype(np.int32))],
                    names=["doc_id", "held_out", "score", "predicted"],
                )

    return run


def labelled(table: pa.Table) -> list[tuple[int, np.ndarray]]:
    return [(y, np.asarray(f.values.to_numpy())) for y, f in zip(table["label"].to_pylist(), table["features"], strict=True)]


def score_quality(
    docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, bits: int = BITS, threshold: float = 0.7, fold: tuple[int, int] = (4, 2), features: int = FEATURES
) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``.

    Labels of the held-out fold, null labels and labels other than 0 and 1 are not learned
    from; at most ``sample`` rows and ``features`` features of each class are. Null and empty
    texts have no features and are scored by the bias; texts of any length are scored whole.
    Repeated rows are scored each, alike; a null id is not held out; without labels of both
    classes all scores are equal; an empty table gives an empty one. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    known = bounded_sample(known.where(F.col("label").isin(0, 1) & ~held_out("doc_id", *fold)).distinct(), "doc_id", "label", sample)
    learned = rows.join(F.broadcast(known), "doc_id").select("doc_id", "label", "text")  # `sample` rows a class at most
    made = learned.mapInArrow(_featured(bits), "doc_id long, label int, features array<int>")
    found = fitted_in_one_task(made, "label", lambda rows: fit(labelled(rows), bits), features)
    model = spark.sparkContext.broadcast(found or fit([], bits))
    marked = rows.select("doc_id", held_out("doc_id", *fold).alias("held_out"), "text")
    return marked.mapInArrow(_score(model, bits, threshold), "doc_id long, held_out boolean, score double, predicted int")
