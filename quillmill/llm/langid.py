"""Language identification by hierarchical discrimination.

A first stage tells language families apart; within a family, one-versus-one linear support
vector machines separate the related languages, and only the chosen family's machines read a
text. All read relative frequencies of three- and four-byte letter grams of the whole text and
are fitted by dual coordinate descent. Codes that no listed family has are gathered into
families of up to ``GATHERED`` by the likeness of their mean frequencies, so that the number of
machines grows hardly faster than that of languages.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytewords as bw
from . import hashed
from .linear import FEATURES, Rows, bounded_sample, fitted_in_one_task, held_out, hinge_by_dual_descent, logistic_scale

BITS = 16
#: Rows of each language that the machines learn from, at most.
SAMPLE = 800
SCALE = 40.0

#: Languages of a family that is gathered from unlisted codes, at most.
GATHERED = 8

#: Families of common language codes; any other code is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "fy"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"),
    "finnic": ("fi", "et"),
    "baltic": ("lt", "lv"),
    "turkic": ("tr", "az", "kk", "uz"),
}


def families_of(langs: list[str], rows: Rows, bits: int) -> dict[str, str]:
    """Each code's family: the listed one, or one gathered with the unlisted codes most like it."""
    found = {x: next((name for name, codes in FAMILIES.items() if x in codes), "") for x in sorted(set(langs))}
    loose = [x for x, name in found.items() if not name]
    if not loose:
        return found
    names = np.array(langs, dtype=object)
    mean = np.stack([rows.transposed_dot((names == x).astype(float), 1 << bits) for x in loose])
    mean /= np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-9)
    like = mean @ mean.T
    rest = list(range(len(loose)))
    while rest:
        head = rest.pop(0)
        near = sorted(rest, key=lambda i: -like[head, i])[: GATHERED - 1]
        near = [i for i in near if like[head, i] >= 0.3]
        rest = [i for i in rest if i not in near]
        found |= {loose[i]: f"like:{loose[head]}" for i in [head, *near]}
    return found


def frequencies(data: np.ndarray, offsets: np.ndarray, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    grams, _ = hashed.letter_grams(data, offsets, bits)
    out = []
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        index, count = np.unique(grams[:, a:b], return_counts=True)
        index, count = index[index > 0], count[index > 0] if len(index) else count
        out.append((index, count / max(1, count.sum()) * SCALE))
    return out


def _featured(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in bw.chunks(batch.column(2)):
                found = frequencies(data, offsets, bits)
                n = len(found)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, n), batch.column(1).slice(row, n), pa.array([x for x, _ in found], pa.list_(pa.int32())), pa.array([x for _, x in found], pa.list_(pa.float32()))],
                    names=["doc_id", "lang", "features", "values"],
                )

    return run


class Machines:
    """One-versus-one machines: families first, then the languages of each family."""

    def __init__(self, langs: list[str], rows: Rows, bits: int):
        self.langs = sorted(set(langs))
        self.family = families_of(langs, rows, bits)
        self.families = sorted(set(self.family.values()))
        size, names = 1 << bits, np.array(langs, dtype=object)
        of = np.array([self.family[x] for x in langs], dtype=object)

        def fit(codes: np.ndarray, a: str, b: str):
            """(weights, bias, slope, shift): of the rows of two codes a fifth is kept for the curve."""
            chosen = np.flatnonzero((codes == a) | (codes == b))
            held = chosen[::5] if len(chosen) >= 10 else chosen
            fitted = np.setdiff1d(chosen, held) if len(chosen) >= 10 else chosen
            w, c = hinge_by_dual_descent(rows.take(fitted), np.where(codes[fitted] == a, 1, -1), size, epochs=12)
            w[0] = 0  # the number of places that hold no gram
            return w.astype(np.float16), c, *logistic_scale(rows.take(held).dot(w) + c, (codes[held] == a).astype(int))

        self.between = {(a, b): fit(of, a, b) for a, b in combinations(self.families, 2)}
        self.within = {f: {(a, b): fit(names, a, b) for a, b in combinations(self.members(f), 2)} for f in self.families}

    def members(self, family: str) -> list[str]:
        return [x for x in self.langs if self.family[x] == family]

    def predict(self, grams: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language numbers, scores and numbers of grams, for rows whose grams lie between offsets."""
        n = len(offsets) - 1
        lang, score, used = np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
        filled = np.flatnonzero(np.diff(offsets) > 0)
        if not self.langs or not len(filled):
            return lang, score, used
        used[filled] = sum(np.add.reduceat((g > 0).astype(np.float64), offsets[filled]) for g in grams)

        def contest(names: list[str], machines: dict, some: np.ndarray, grams: np.ndarray, starts: np.ndarray):
            """The winner of each row and the least chance it has against another."""
            won, least = np.zeros((len(names), len(some))), np.ones((len(names), len(some)))
            for (a, b), (w, c, slope, shift) in machines.items():
                margin = sum(np.add.reduceat(w[g].astype(np.float64), starts) for g in grams) / np.maximum(used[some], 1) * SCALE + c
                p = 1 / (1 + np.exp(-np.clip(slope * margin + shift, -30, 30)))
                for name, q in ((a, p), (b, 1 - p)):
                    i = names.index(name)
                    won[i] += (q > 0.5) + q / (2 * len(names))
                    least[i] = np.minimum(least[i], q)
            best = won.argmax(axis=0)
            return best, least[best, np.arange(len(some))]

        chosen, sure = contest(self.families, self.between, filled, grams, offsets[filled])
        for f, name in enumerate(self.families):
            mine = filled[chosen == f]
            if not len(mine):
                continue
            sizes = np.diff(offsets)
            ours = np.zeros(n, bool)
            ours[mine] = True
            own = grams[:, np.repeat(ours, sizes)] if len(mine) < len(filled) else grams
            members = self.members(name)
            best, p = contest(members, self.within[name], mine, own, np.cumsum(sizes[mine]) - sizes[mine])
            lang[mine] = np.array([self.langs.index(x) for x in members])[best]
            score[mine] = sure[chosen == f] * p
        return lang, score, used


def _machines(bits: int):
    def fit(rows: pa.Table) -> Machines:
        lists, values = ([np.asarray(x.values.to_numpy()) for x in rows[c]] for c in ("features", "values"))
        return Machines(rows["lang"].to_pylist(), Rows(lists, values), bits)

    return fit


def _predict(model, bits: int, whole: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machines: Machines = model.value
        for batch in batches:
            for row, data, offsets in bw.chunks(batch.column(2)):
                n = len(offsets) - 1
                grams, _ = hashed.letter_grams(data, offsets, bits)
                filled = np.flatnonzero(np.diff(offsets) > 0)
                lang, score, used = machines.predict(grams, offsets)
                texts = batch.column(2).slice(row, n)
                plain = hashed.letter_bytes(data) != 0x20
                some = np.zeros(n, dtype=bool)
                some[filled] = np.add.reduceat(plain, offsets[filled]) > 0
                for i in np.flatnonzero(some & (used < 8)):  # few bytes: they may be signs outside ASCII
                    some[i] = any(c.isalpha() for c in texts[int(i)].as_py() or "")
                for i in np.flatnonzero(some & (used >= 8)):
                    body = data[offsets[i] : offsets[i + 1]]
                    if not ((body >= 0x41) & ((body | 0x20) >= 0x61) & ((body | 0x20) <= 0x7A)).any():
                        some[i] = any(c.isalpha() for c in texts[int(i)].as_py())
                names = [machines.langs[k] if ok and machines.langs else "und" for k, ok in zip(lang, some, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(row, n), batch.column(1).slice(row, n), pa.array(names, pa.string()), pa.array(np.where(some, score, 0.0)),
                        *(batch.column(i).slice(row, n) for i in range(2 if whole else 3, batch.num_columns)),
                    ],
                    names=["doc_id", "held_out", "lang_pred", "score", *batch.schema.names[2 if whole else 3 :]],
                )

    return run


def identify_language(
    docs: DataFrame, sample: int = SAMPLE, bits: int = BITS, fold: tuple[int, int] = (3, 1), carry: tuple[str, ...] = (), features: int = FEATURES
) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of ``docs``, and its columns ``carry``.

    Learned from rows with a language outside the held-out fold, up to ``sample`` rows and
    ``features`` features of each. Texts that are null or have no letter, and all texts if nothing
    can be learned, are ``und`` with score 0. Texts are read whole, however long. Repeated rows
    are judged each, alike; rows with a null id are judged, and not learned from; of languages
    level in votes the first in order wins; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    usable = rows.where(F.col("text").isNotNull() & (F.trim("text") != "") & ~held_out("doc_id", *fold))
    chosen = bounded_sample(usable.select("doc_id", "lang"), "doc_id", "lang", sample)
    learned = usable.join(F.broadcast(chosen.distinct()), ["doc_id", "lang"]).select("doc_id", "lang", "text")  # `sample` rows a language at most
    made = learned.mapInArrow(_featured(bits), "doc_id long, lang string, features array<int>, values array<float>")
    machines = fitted_in_one_task(made, "lang", _machines(bits), features) or Machines([], Rows([], []), bits)
    model = spark.sparkContext.broadcast(machines)
    ids = F.col("doc_id").cast("long").alias("doc_id")
    carried = [F.col(c).alias(f"carry_{c}") for c in carry if c != "text"]  # the text goes along once
    marked = docs.select(ids, held_out("doc_id", *fold).alias("held_out"), F.col("text").cast("string").alias("text"), *carried)
    whole = "text" in carry
    kinds = ", text string" * whole + "".join(f", carry_{c} {docs.schema[c].dataType.simpleString()}" for c in carry if c != "text")
    out = marked.mapInArrow(_predict(model, bits, whole), f"doc_id long, held_out boolean, lang_pred string, score double{kinds}")
    return out.select("doc_id", "held_out", "lang_pred", "score", *(F.col("text" if c == "text" else f"carry_{c}").alias(c) for c in carry))
