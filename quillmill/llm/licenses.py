"""Licence scans by a trained paragraph classifier, in DataFrame operations only.

A paragraph is a line, each of its sentences, and a wrapped line with the two that follow it.
Its features are runs of one to three words that hold a word of the templates other than a
function word. A softmax regression, trained on the driver from fixed templates and
counter-examples, weighs them for each licence family and for the class ``unknown``; its
temperature is calibrated on templates and counter-examples of which the fit has seen no
variant. A prediction is confirmed by comparison with the family's templates: enough of the
paragraph's, or the template's, word pairs must be shared. Training touches no table, so its
size is fixed.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import cut

# Customary notices of each licence family.
TEMPLATES = {
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "This project is released under the terms of the Apache License 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    ),
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "This software is distributed under the terms of the MIT License.",
        "SPDX-License-Identifier: MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction.',
        "Released under MIT.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU GPL version 3 or later.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "Released under the GNU General Public License, version 2.",
    ),
    "lgpl": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
    ),
    "agpl": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ),
    "bsd": (
        "Licensed under the BSD 3-Clause License.",
        "BSD 3-Clause",
        "Use of this source code is governed by a BSD-style license.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ),
    "isc": (
        "Released under the ISC License.",
        "Licensed under the ISC license.",
        "SPDX-License-Identifier: ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "epl": (
        "This program is made available under the terms of the Eclipse Public License, v. 2.0.",
        "Licensed under the Eclipse Public License, version 2.0.",
        "SPDX-License-Identifier: EPL-2.0",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "This content is available under CC BY-NC-SA 4.0 for noncommercial use.",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "Available under CC BY 4.0.",
        "Creative Commons Attribution 4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License, CC BY-SA 4.0.",
    ),
    "public-domain": (
        "Released into the public domain under CC0 1.0 Universal.",
        "This is free and unencumbered software released into the public domain.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    ),
    "proprietary": (
        "All rights reserved. No part of this publication may be reproduced without prior written permission.",
        "This software is proprietary and confidential. Unauthorized copying of this file is strictly prohibited.",
        "Copyright by the publisher. All rights reserved.",
    ),
}
# Counter-examples: prose that shares words with notices but states no licence.
OTHERS = (
    "The driver must carry a valid license at all times and show it on request.",
    "She renewed her fishing license last spring and released the fish into the lake.",
    "The band released a new version of the song under a different title.",
    "Students at MIT published a paper about free software and public policy.",
    "The committee will publish the general terms of the agreement next week.",
    "A copy of the report was distributed to the public without any conditions.",
    "The restaurant obtained a license to serve wine and beer.",
    "He wrote the source of the river is in the mountains and the file was lost.",
    "This work was done by a team of volunteers and is based on earlier notes.",
    "Version two of the program is faster than version one in most cases.",
    "Please read the above notice before you use the machine.",
    "The Apache helicopter flew over the valley in the morning.",
    "The library is open to any person who lives in the city.",
    "All visitors must retain the ticket and include it in the form.",
    "Redistribution of wealth was the main subject of the debate.",
    "The foundation gave a grant of one million to the general hospital.",
    "The author has published four books on the history of law and rights.",
    "Warranties on the product are valid for two years from the date of purchase.",
    "The commercial was shown on television and is available on the web.",
    "Permission was granted to build the house at the end of the road.",
)
UNKNOWN = "unknown"
# Function words, which tell nothing of a licence when they stand alone.
FUNCTION = frozenset(
    "a all an and any are as at be been but by can either every for from had has have he her his i if in into is it its may must no not of on or "
    "our shall she should so than that the their them then there these they this those to was we were which who will with without you your".split()
)


def words_of(text: str) -> list[str]:
    return [w for w in re.split(r"[^a-z0-9]+", text.lower()) if w]


def grams_of(words: list[str]) -> set[str]:
    return {" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}


def sentences_of(text: str) -> list[str]:
    """The text's sentences and clauses, each of which can stand as a notice of its own."""
    return [x for x in re.split(r"(?<=[a-z)][.;])\s+", text) if len(words_of(x)) > 2]


def training_rows(seed: int = 3, each: int = 12) -> list[tuple[str, list[str], int]]:
    """(family, words, text) of templates, their sentences, counter-examples, and variants of them
    with words dropped or added; variants and parts of one text share its number."""
    rng = np.random.default_rng(seed)
    rows: list[tuple[str, list[str], int]] = []
    vocabulary = sorted({w for t in OTHERS for w in words_of(t)})
    bases = [(family, t) for family, texts in [*TEMPLATES.items(), (UNKNOWN, OTHERS)] for t in texts]
    for number, (family, whole) in enumerate(bases):
        for text in dict.fromkeys((whole, *sentences_of(whole))):
            words = words_of(text)
            rows.append((family, words, number))
            for _ in range(each):
                made = [w for w in words if rng.random() > 0.1] or words
                at = int(rng.integers(len(made) + 1))
                extra = [vocabulary[i] for i in rng.integers(len(vocabulary), size=int(rng.integers(0, 6)))]
                rows.append((family, made[:at] + extra + made[at:], number))
    pool = sorted({w for texts in TEMPLATES.values() for t in texts for w in words_of(t)})
    for i in range(40 * each):  # salads: licence words without their order are no licence
        mixed = pool if rng.random() < 0.3 else vocabulary
        rows.append((UNKNOWN, [mixed[i] for i in rng.integers(len(mixed), size=int(rng.integers(1, 25)))], len(bases) + i))
    return rows + [(UNKNOWN, [w], -1) for w in pool for _ in range(3)]  # nor is one word alone


def _descended(x: np.ndarray, target: np.ndarray, rounds: int, ridge: float) -> tuple[np.ndarray, np.ndarray]:
    w, b = np.zeros((x.shape[1], target.shape[1])), np.zeros(target.shape[1])
    state = [np.full_like(w, 1e-8), np.full_like(b, 1e-8)]
    for _ in range(rounds):
        z = x @ w + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        for value, grad, past in zip((w, b), (x.T @ (p - target) / len(x) + ridge * w, (p - target).mean(axis=0)), state, strict=True):
            past += grad**2
            value -= 0.3 * grad / np.sqrt(past)
    return w, b


@lru_cache(maxsize=1)
def trained(rounds: int = 400, ridge: float = 0.002) -> tuple[list[str], dict[str, list[float]], list[float], frozenset[str]]:
    """(classes, weights of each feature, biases, anchor words), temperature applied.

    Features are n-grams that hold an anchor, a template word that is no function word; a
    paragraph without any feature has the biases alone and is unknown. A first fit without a
    fourth of the texts gives the temperature, a second one over all the weights.
    """
    rows = training_rows()
    classes = sorted(TEMPLATES) + [UNKNOWN]
    anchors = frozenset(w for texts in TEMPLATES.values() for t in texts for w in words_of(t)) - FUNCTION
    found = [sorted(g for g in grams_of(w) if anchors & set(g.split())) for _, w, _ in rows]
    counts: dict[str, int] = {}
    for grams in found:
        for g in grams:
            counts[g] = counts.get(g, 0) + 1
    names = sorted(g for g, n in counts.items() if n >= 4)
    place = {g: i for i, g in enumerate(names)}
    x = np.zeros((len(rows), len(names)), np.float32)
    for i, grams in enumerate(found):
        x[i, [place[g] for g in grams if g in place]] = 1
    y = np.array([classes.index(c) for c, _, _ in rows])
    target = np.eye(len(classes), dtype=np.float32)[y]
    held = np.array([number >= 0 and number % 4 == 1 for _, _, number in rows])
    w, b = _descended(x[~held], target[~held], rounds // 2, ridge)

    def loss(t: float) -> float:
        z = (x[held] @ w + b) / t
        z -= z.max(axis=1, keepdims=True)
        return float(-(z[np.arange(held.sum()), y[held]] - np.log(np.exp(z).sum(axis=1))).mean())

    heat = min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0), key=loss)
    w, b = _descended(x, target, rounds, ridge)
    return classes, {g: (w[i] / heat).astype(float).tolist() for g, i in place.items()}, (b / heat).astype(float).tolist(), anchors


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), "")


def _grams(words: Column) -> Column:
    """Distinct runs of one to three words of a word array."""
    shifted = [words, F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 3, F.greatest(F.size(words) - 2, F.lit(0)))]
    pairs = F.zip_with(shifted[0], shifted[1], lambda a, b: F.concat(a, F.lit(" "), b))
    triples = F.zip_with(pairs, shifted[2], lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(F.array_compact(F.concat(words, pairs, triples)))


def _pairs(words: list[str]) -> list[str]:
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])} or set(words))


def _units(text: Column, wrap: int | None) -> Column:
    """(paragraph, line, joined) of every line, and of each wrapped line joined with the two after it.

    A line of ``wrap`` characters or more that ends in no stop counts as wrapped; ``paragraph`` is
    the number of the (first) line.
    """
    def of(lines: Column) -> Column:
        single = F.transform(lines, lambda x, i: F.struct(i.alias("paragraph"), x.alias("line"), F.lit(False).alias("joined")))
        if wrap is None:
            return single
        goes_on = lambda x, i: (F.length(x) >= wrap) & ~x.rlike(r"[.!?:;]\s*$") & (F.coalesce(F.get(lines, i + 1), F.lit("")) != "")
        joined = F.transform(lines, lambda x, i: F.when(goes_on(x, i), F.struct(i.alias("paragraph"), F.array_join(F.slice(lines, i + 1, 3), " ").alias("line"), F.lit(True).alias("joined"))))
        return F.concat(single, F.array_compact(joined))

    return F.get(F.transform(F.array(F.split(text, "\r\n|\r|\n")), of), 0)


def scan_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = 0.5, overlap: float = 0.6, wrap: int | None = 50) -> DataFrame:
    """(doc_id, paragraph, family, probability, overlap, confirmed): paragraphs that state a licence.

    A line, or one of its sentences, states the family that is its most likely class if that has
    at least ``least`` probability; a line can so state several families, each of which gets one
    row with its best figures. A wrapped line and the two after it count as one where no line
    among them alone is confirmed for the family. ``overlap`` is the share of word pairs in
    common with the closest template of the family, of the smaller side. Levels of probability
    between classes go to the first family by name. Null and empty texts have no rows; texts are
    read whole, however long; rows of one id and text are scanned as one, rows of one id with
    other texts each; a null doc_id is returned as such; an empty table gives an empty one;
    other columns are ignored. Paragraphs count from 0.
    """
    spark = docs.sparkSession
    classes, weights, biases, anchors = trained()
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where("text is not null")
    lines = base.select("doc_id", F.xxhash64("text").alias("doc_mark"), F.inline(_units(F.col("text"), wrap)))
    # Lines without a feature are unknown whatever else they hold, so nothing is lost here.
    lines = lines.where(F.exists(_words(F.col("line")), lambda w: w.isin(sorted(anchors))))
    parts = F.array_distinct(F.concat(F.array("line"), F.when(F.col("joined"), F.array().cast("array<string>")).otherwise(F.split("line", r"(?<=[.;!?])\s+"))))
    lines = lines.select("doc_id", "doc_mark", "paragraph", "joined", F.explode(parts).alias("line"))
    known = lines.withColumn("grams", F.filter(_grams(_words(F.col("line"))), lambda g: g.isin(sorted(weights)))).where(F.size("grams") > 0)
    table = spark.createDataFrame([(g, *w) for g, w in sorted(weights.items())], "gram string, " + ", ".join(f"w{i} double" for i in range(len(classes))))
    # Written, since scores of distinct lines and the places of all lines both come from it.
    keyed = cut(known.select("doc_id", "doc_mark", "paragraph", "joined", F.xxhash64("line").alias("mark"), "line", "grams"), "lines")
    grams = keyed.select("mark", F.explode("grams").alias("gram"), "line").distinct()
    summed = grams.join(F.broadcast(table), "gram").groupBy("mark", "line").agg(*(F.sum(f"w{i}").alias(f"s{i}") for i in range(len(classes))))
    logits = [F.exp(F.col(f"s{i}") + F.lit(b)) for i, b in enumerate(biases)]
    names = F.array(*map(F.lit, classes))

    def chosen(e: Column) -> Column:
        top = F.array_max(e)
        total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
        return F.struct((top / total).alias("probability"), F.element_at(names, F.array_position(e, top).cast("int")).alias("family"))

    best = summed.select("mark", "line", F.get(F.transform(F.array(F.array(*logits)), chosen), 0).alias("of")).select("mark", "line", "of.*")
    best = best.where((F.col("family") != UNKNOWN) & (F.col("probability") >= least))
    words = _words(F.col("line"))
    own = F.array_distinct(F.array_compact(F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))))
    told = spark.createDataFrame([(f, [_pairs(words_of(t)) for t in texts]) for f, texts in TEMPLATES.items()], "family string, told array<array<string>>")
    best = best.withColumn("own", own).join(F.broadcast(told), "family")
    close = F.array_max(F.transform("told", lambda x: F.size(F.array_intersect("own", x)) / F.greatest(F.least(F.size("own"), F.size(x)), F.lit(1))))
    best = best.withColumn("overlap", close).select("mark", "line", "family", F.round("probability", 6).alias("probability"), F.round("overlap", 6).alias("overlap"))
    hits = keyed.select("doc_id", "doc_mark", "paragraph", "joined", "mark", "line").join(best, ["mark", "line"])
    stated = hits.groupBy("doc_id", "doc_mark", "paragraph", "family", "joined").agg(F.max("probability").alias("probability"), F.max("overlap").alias("overlap"))
    stated = stated.withColumn("confirmed", F.col("overlap") >= overlap)
    near = Window.partitionBy("doc_id", "doc_mark", "family").orderBy("paragraph").rangeBetween(0, 2)
    alone = F.max(~F.col("joined") & F.col("confirmed")).over(near)
    stated = stated.withColumn("alone", alone).where(~F.col("joined") | (F.col("confirmed") & ~F.col("alone")))
    out = stated.groupBy("doc_id", "doc_mark", "paragraph", "family").agg(F.max("probability").alias("probability"), F.max("overlap").alias("overlap"), F.max("confirmed").alias("confirmed"))
    return out.drop("doc_mark")
