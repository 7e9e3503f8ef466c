"""The trained operators recomputed plainly: features text by text, decisions from the same models."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmill.llm import bytewords as bw
from quillmill.llm import hashed, langid, linear, quality, toxicity
from quillmill.llm.linear import Rows

ODD = ["", " ", "A", "Don't STOP!! 12,5 %", "é È ß — «x» 日本", "a\x01b\tc\r\nd", "x" * 70_000, "Ab1-c_D " * 9000]


def one_hash(word: bytes, lower: bool = False) -> int:
    data = np.frombuffer(word, np.uint8)
    return int(bw.word_hashes(data, np.array([0]), np.array([len(word)]), lower)[0])


def gram(hashes: list[int]) -> int:
    return int(bw.gram_hashes(np.array(hashes, np.uint64), np.array([0, len(hashes)]), len(hashes))[1][0])


def arrays(texts):
    parts = [t.encode() for t in texts]
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)])


def plain_terms(text: str, bits: int) -> set[int]:
    bare = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in text.encode().lower())
    found = [one_hash(w) for w in bare.split(b" ") if w]
    return {h & ((1 << bits) - 1) for h in found + [gram(list(p)) for p in zip(found, found[1:])]}


def plain_styles(text: str, bits: int) -> set[int]:
    words = re.findall(rb"[^\x20\x09-\x0D]+", text.encode())
    kinds = {**{c: b"a" for c in b"abcdefghijklmnopqrstuvwxyz"}, **{c: b"A" for c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"}, **{c: b"0" for c in b"0123456789"}}
    shapes = []
    for w in words:
        signs = [kinds.get(b, b"a" if b >= 0x80 else bytes([b])) for b in w]
        shapes.append(one_hash(b"".join(x for i, x in enumerate(signs) if not i or x != signs[i - 1])))
    out = {one_hash(w, lower=True) for w in words}
    for k in (1, 2, 3):
        for i in range(len(shapes) - k + 1):
            out.add(int(bw.mix(np.array([gram(shapes[i : i + k])], np.uint64) ^ np.uint64(0x5F00 + k))[0]))
    return {h & ((1 << bits) - 1) for h in out}


@pytest.mark.parametrize(("vector", "plain"), [(hashed.term_features, plain_terms), (hashed.style_features, plain_styles)])
def test_features_equal_a_plain_recomputation(vector, plain):
    rng = random.Random(1)
    texts = ODD + [" ".join("".join(rng.choices("abcXYZ09.é-", k=rng.randrange(1, 7))) for _ in range(rng.randrange(40))) for _ in range(30)]
    index, start = vector(*arrays(texts), 40)
    for i, text in enumerate(texts):
        assert set(index[start[i] : start[i + 1]].tolist()) == plain(text, 40), text[:30]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(6)
    good, bad = [f"g{i}a" for i in range(60)], ["idiot", "scum", "trash"]
    texts, rows = [], []
    for i in range(240):
        w = [rng.choice(good) for _ in range(40)]
        q, t = int(i % 3 > 0), i % 4
        w = w if q else [x.upper() + "!!" for x in w]
        w[5:5] = rng.sample(bad, t)
        texts.append(" ".join(w))
        rows.append((i, q, t))
    texts += [None, "", "y " * 60_000, texts[0]]
    docs = spark.createDataFrame([(i if i < 243 else 0, t, 1, 1, 1) for i, t in enumerate(texts)] + [(None, texts[1], 1, 1, 1)], "doc_id long, text string, label int, score int, held_out int")
    return docs, spark.createDataFrame([*rows, (None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int"), rows, texts


def learned(rows, at, texts, features, bits):
    """(label, features) rows of the fold that is learned from, in the order of ids; row 0 comes twice."""
    known = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    known = [r for r in known for _ in range(2 if r[0] == 0 else 1)]
    return [(r[at], np.array(sorted(features(texts[r[0]], bits)))) for r in known]


def test_quality_equals_a_plain_recomputation(spark, corpus):
    docs, labels, rows, texts = corpus
    ratio, weight, bias, a, b = quality.fit(learned(rows, 1, texts, plain_styles, quality.BITS))
    got = quality.score_quality(docs, labels).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        text = texts[1] if r.doc_id is None else texts[r.doc_id]
        found = sorted(plain_styles(text or "", quality.BITS))
        margin = weight[found].sum() / max(np.sqrt((ratio[found].astype(float) ** 2).sum()), 1e-9) + bias
        assert abs(r.score - 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))) < 1e-4 and r.predicted == (r.score >= 0.7)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    assert quality.score_quality(docs.limit(0), labels).count() == 0
    assert {round(r.score, 9) for r in quality.score_quality(docs, labels.where("quality = 1")).collect()} == {0.999}


def test_toxicity_equals_a_plain_recomputation(spark, corpus):
    docs, labels, rows, texts = corpus
    names, weight, theta = toxicity.fit(learned(rows, 2, texts, plain_terms, toxicity.BITS))
    of = dict(zip(names.tolist(), weight.tolist(), strict=True))
    got = toxicity.score_toxicity(docs, labels).collect()
    assert len(theta) == 3 and len(got) == len(texts) + 1
    for r in got:
        text = texts[1] if r.doc_id is None else texts[r.doc_id]
        chance = 1 / (1 + np.exp(theta - sum(of.get(h, 0.0) for h in plain_terms(text or "", toxicity.BITS))))
        assert abs(r.severity - chance.sum()) < 1e-6 and abs(r.p_toxic - chance[0]) < 1e-6 and r.grade == (chance >= 0.5).sum()
    # Severity follows the graded labels on rows that were not learned from.
    held = [(t, r.severity, r.grade) for i, _, t in rows for r in got if r.doc_id == i and r.held_out]
    assert np.mean([t == g for t, _, g in held]) > 0.85 and np.corrcoef([t for t, _, _ in held], [s for _, s, _ in held])[0, 1] > 0.9
    assert toxicity.score_toxicity(docs.limit(0), labels).count() == 0


def test_language_equals_a_plain_recomputation(spark):
    rng = random.Random(9)
    stock = {"en": "the and of thing with tion", "de": "der und schön ung ich keit", "fr": "le et où être eau tion", "es": "el y año ción que mente", "xx": "qo vix zuk", "yy": "qo vix zul", "zz": "дом и мир"}
    rows = [(i, " ".join(rng.choices(stock[x].split(), k=20)), x) for i, x in enumerate(sorted(stock) * 24)]
    rows += [(900, None, "en"), (901, "12 34 !!", "en"), (902, "", None), (None, rows[0][1], None), (0, rows[0][1], "de"), (903, "the " * 50_000, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit(1)).withColumn("held_out", F.lit(2))
    bits = langid.BITS

    def freq(text):
        data = bytes(hashed.letter_bytes(np.frombuffer(text.encode(), np.uint8)))
        count = {}
        for size in (3, 4):
            for p in range(len(data) - size + 1):
                if data[p] != 0x20:
                    code = int.from_bytes(data[p : p + size], "big")
                    h = int(bw.mix(np.array([code + (size << 40)], np.uint64))[0]) & ((1 << bits) - 1)
                    count[h] = count.get(h, 0) + 1
        count.pop(0, None)
        total = max(1, sum(count.values()))
        return {h: n / total * langid.SCALE for h, n in count.items()}

    fit = sorted((i, x, t) for i, t, x in rows if t and t.strip() and x and i is not None and zlib.crc32(str(i).encode()) % 3 != 1)
    found = [freq(t) for _, _, t in fit]
    machines = langid.Machines([x for _, x, _ in fit], Rows([np.array(sorted(f)) for f in found], [np.array([f[h] for h in sorted(f)]) for f in found]), bits)
    assert machines.family["xx"] == machines.family["yy"] != machines.family["zz"] and machines.family["fr"] == "romance"

    def contest(names, pairs, f):
        won, least = dict.fromkeys(names, 0.0), dict.fromkeys(names, 1.0)
        for (a, b), (w, c, slope, shift) in pairs.items():
            p = 1 / (1 + np.exp(-np.clip(slope * (sum(float(w[h]) * v for h, v in f.items()) + c) + shift, -30, 30)))
            for x, q in ((a, p), (b, 1 - p)):
                won[x] += (q > 0.5) + q / (2 * len(names))
                least[x] = min(least[x], q)
        best = max(names, key=lambda x: won[x])
        return best, least[best]

    got = langid.identify_language(frame).collect()
    assert len(got) == len(rows)
    texts = {i: t for i, t, _ in rows}
    for r in got:
        text = texts[r.doc_id]
        if not text or not any(c.isalpha() for c in text):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        f = freq(text)
        family, sure = contest(machines.families, machines.between, f)
        lang, p = contest(machines.members(family), machines.within[family], f)
        assert r.lang_pred == lang and abs(r.score - sure * p) < 1e-3
    assert langid.identify_language(frame.limit(0)).count() == 0


def test_bounded_samples(spark):
    """The smallest hashes of each label, whatever its size; features are bounded in the same order."""
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 100 == 0, 1).otherwise(0).alias("label"))
    got = linear.bounded_sample(rows, "doc_id", "label", 150).collect()
    order = [r.doc_id for r in rows.where("label = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(150).collect()]
    assert {r.doc_id for r in got if r.label == 0} == set(order) and sum(r.label for r in got) == 150
    made = rows.where("doc_id < 1000").withColumn("features", F.array_repeat(F.lit(1), 10))
    assert linear.fitted_in_one_task(made, "label", lambda t: (t.num_rows, sum(t["label"].to_pylist())), 55) == (10, 5)
    assert linear.fitted_in_one_task(made.limit(0), "label", len) is None


def test_a_row_that_does_not_fit_is_left_out_alone(spark):
    """One oversize row, first in order, takes no place from the smaller ones of its label."""
    rows = spark.range(40).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("label"))
    first = rows.where("label = 1").orderBy(F.xxhash64("doc_id")).first().doc_id
    made = rows.withColumn("features", F.array_repeat(F.lit(1), F.when(F.col("doc_id") == first, 1000).otherwise(20)))
    assert linear.fitted_in_one_task(made, "label", lambda t: sorted(t["label"].to_pylist()), 500) == [0] * 20 + [1] * 19


def test_an_oversize_text_does_not_empty_a_label(spark):
    """Quality, language and toxicity still learn a label whose first text in order passes the bound on features."""
    rng = random.Random(3)
    words = {1: [f"good{i}" for i in range(30)], 0: [f"bad{i}" for i in range(30)]}
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 != 2 and zlib.crc32(str(i).encode()) % 3 != 1][:120]
    texts = {i: " ".join(rng.choice(words[i % 2]) for _ in range(30)) for i in ids}
    order = spark.createDataFrame([(i,) for i in ids if i % 2], "doc_id long").orderBy(F.xxhash64("doc_id")).first().doc_id
    texts[order] = " ".join(f"good{i} z{i}" for i in range(20_000))
    docs = spark.createDataFrame([(i, t, ("de", "en")[i % 2]) for i, t in texts.items()], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in ids], "doc_id long, quality int, toxic int")
    asked = [i for i in ids if i != order]
    quality_of = {r.doc_id: r.predicted for r in quality.score_quality(docs, labels, features=10_000).collect()}
    lang_of = {r.doc_id: r.lang_pred for r in langid.identify_language(docs, features=30_000).collect()}
    assert [quality_of[i] for i in asked] == [i % 2 for i in asked]
    assert [lang_of[i] for i in asked] == [("de", "en")[i % 2] for i in asked]
    toxic = spark.createDataFrame([(i, i % 2, i % 2) for i in ids], "doc_id long, quality int, toxic int")
    grades = {r.doc_id: r.severity for r in toxicity.score_toxicity(docs, toxic, features=10_000).collect()}
    assert min(grades[i] for i in asked if i % 2) > max(grades[i] for i in asked if i % 2 == 0)
