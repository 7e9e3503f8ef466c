"""Toxicity by cumulative-link ordinal regression.

Grades are ordered: 0 for clean texts, and 1, 2, ... for rising severity. One weight vector
over sparse term indicators is shared by all thresholds; P(grade >= j) is logistic in the
text's sum of weights minus threshold j. The expected severity is the sum of these chances.

A label column with more than two values gives the grades itself. A plain 0/1 label is graded
first: a toxic text with more than the median number of marker terms (terms with a high
smoothed log-odds of toxicity among learned rows) is grade 2, any other toxic text grade 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytewords as bw
from . import hashed
from .linear import FEATURES, Rows, bounded_sample, fitted_in_one_task, held_out
from .quality import labelled

#: Bits of a term's number: enough that rare words do not fall on a telling one's number.
BITS = 40
#: Labelled rows of each label that the model learns from, at most.
SAMPLE = 3000
#: Terms kept, by their log-likelihood ratio.
TERMS = 4000


def _featured(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in bw.chunks(batch.column(2)):
                index, start = hashed.term_features(data, offsets, bits)
                n = len(offsets) - 1
                lists = pa.ListArray.from_arrays(pa.array(start, pa.int32()), pa.array(index, pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, n), batch.column(1).slice(row, n), lists], names=["doc_id", "label", "features"])

    return run


def _evidence(rows: Rows, toxic: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Signed likelihood ratio and smoothed log-odds of each term."""
    n1, n0 = max(1, int(toxic.sum())), max(1, int((~toxic).sum()))
    c1, c0 = (rows.transposed_dot(m.astype(float), size) for m in (toxic, ~toxic))
    p1, p0, p = (c1 + 0.5) / (n1 + 1), (c0 + 0.5) / (n0 + 1), (c1 + c0 + 1) / (n1 + n0 + 2)
    gain = c1 * np.log(p1 / p) + (n1 - c1) * np.log((1 - p1) / (1 - p)) + c0 * np.log(p0 / p) + (n0 - c0) * np.log((1 - p0) / (1 - p))
    return np.where(c1 + c0 >= 5, gain, 0), np.log(p1 / (1 - p1)) - np.log(p0 / (1 - p0))


def fit(sample: list[tuple[int, np.ndarray]], terms: int = TERMS, ridge: float = 0.3, rounds: int = 300) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(kept term numbers, their weights, thresholds) from (label, term numbers) rows.

    Without two labels there are no terms and no thresholds.
    """
    label = np.array([x[0] for x in sample], dtype=np.int64)
    if len(set(label.tolist())) < 2:
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
    names = np.unique(np.concatenate([x[1] for x in sample]))
    size = len(names)
    sample = [(y, np.searchsorted(names, x)) for y, x in sample]
    rows, toxic = Rows([x[1] for x in sample]), label > 0
    gain, odds = _evidence(rows, toxic, size)
    if len(set(label.tolist())) == 2:
        marker = (gain > 8) & (odds > 2)
        hits = np.bincount(rows.row, weights=marker[rows.index].astype(float), minlength=len(rows))
        grade = np.where(toxic, 1 + (hits > np.median(hits[toxic])), 0)
    else:
        grade = np.searchsorted(np.unique(label), label)
    top = int(grade.max())
    kept = np.argsort(-gain, kind="stable")[:terms]
    # Chance alone gives one of m terms a ratio of about log(m): what does not exceed it is noise.
    kept = kept[gain[kept] > max(3.0, np.log(max(1, int((gain != 0).sum()))))]
    place = np.full(size, -1)
    place[kept] = np.arange(len(kept))
    part = [place[x[1]] for x in sample]
    small = Rows([x[x >= 0] for x in part])
    # Balanced row weights, so that rare grades count as much as common ones.
    weigh = (len(grade) / (len(set(grade.tolist())) * np.bincount(grade, minlength=top + 1)[grade])).astype(float)
    weight, theta = np.zeros(len(kept)), np.linspace(0.0, 1.0, top)
    state = [np.zeros(len(kept)), np.zeros(top)]
    for step in range(rounds):
        eta = small.dot(weight)
        g_eta, g_theta = np.zeros(len(grade)), np.zeros(top)
        # P(grade = g) = s(theta[g] - eta) - s(theta[g - 1] - eta), with outer thresholds infinite.
        upper = np.where(grade < top, 1 / (1 + np.exp(-np.clip(theta[np.minimum(grade, top - 1)] - eta, -30, 30))), 1.0)
        lower = np.where(grade > 0, 1 / (1 + np.exp(-np.clip(theta[np.maximum(grade - 1, 0)] - eta, -30, 30))), 0.0)
        chance = np.maximum(upper - lower, 1e-9)
        du, dl = upper * (1 - upper) / chance * weigh, lower * (1 - lower) / chance * weigh
        g_eta = du - dl
        np.add.at(g_theta, np.minimum(grade, top - 1)[grade < top], -du[grade < top])
        np.add.at(g_theta, (grade - 1)[grade > 0], dl[grade > 0])
        grads = [small.transposed_dot(g_eta, len(kept)) + ridge * weight, g_theta]
        for k, value in enumerate((weight, theta)):  # adaptive steps
            state[k] += grads[k] ** 2
            value -= 0.5 * grads[k] / np.sqrt(state[k] + 1e-8)
        theta[:] = np.maximum.accumulate(theta + np.arange(top) * 1e-6)
    order = np.argsort(names[kept])
    return names[kept][order], weight[order], theta


def _score(model, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, weight, theta = model.value
        for batch in batches:
            for row, data, offsets in bw.chunks(batch.column(2)):
                index, start = hashed.term_features(data, offsets, bits)
                n = len(offsets) - 1
                eta = np.zeros(n)
                if len(names):
                    at = np.minimum(np.searchsorted(names, index), len(names) - 1)
                    hit = np.flatnonzero(names[at] == index)
                    eta = np.bincount(np.searchsorted(start, hit, side="right") - 1, weights=weight[at[hit]], minlength=n)
                chance = 1 / (1 + np.exp(-np.clip(eta[None, :] - theta[:, None], -30, 30))) if len(theta) else np.zeros((1, n))
                grade = (chance >= 0.5).sum(axis=0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, n), batch.column(1).slice(row, n), pa.array(chance.sum(axis=0)), pa.array(chance[0]), pa.array(grade.astype(np.int32)), pa.array((chance[0] >= 0.5).astype(np.int32))],
                    names=["doc_id", "held_out", "severity", "p_toxic", "grade", "toxic"],
                )

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE, bits: int = BITS, fold: tuple[int, int] = (4, 2), features: int = FEATURES) -> DataFrame:
    """(doc_id, held_out, severity, p_toxic, grade, toxic) of every row of ``docs``.

    ``severity`` is the expected grade, ``toxic`` 1 where a grade of at least 1 is likelier
    than not. Labels of the held-out fold, null and negative ones are not learned from, others
    up to ``sample`` rows and ``features`` terms of each. Null and empty texts have no terms;
    without two labels nothing is toxic and severity is 0. Repeated rows are scored each, alike;
    very long texts whole; an empty table gives an empty one; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    known = bounded_sample(known.where((F.col("label") >= 0) & ~held_out("doc_id", *fold)).distinct(), "doc_id", "label", sample)
    learned = rows.join(F.broadcast(known), "doc_id").select("doc_id", "label", "text")  # `sample` rows a label at most
    made = learned.mapInArrow(_featured(bits), "doc_id long, label int, features array<long>")
    found = fitted_in_one_task(made, "label", lambda rows: fit(labelled(rows)), features)
    model = spark.sparkContext.broadcast(found or fit([]))
    marked = rows.select("doc_id", held_out("doc_id", *fold).alias("held_out"), "text")
    return marked.mapInArrow(_score(model, bits), "doc_id long, held_out boolean, severity double, p_toxic double, grade int, toxic int")
