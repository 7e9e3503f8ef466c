"""The corpus pipeline's stages on a small table with planted cases."""

import random

import pytest

import corpus_pipeline
from test_operators import brute_components
from quillmill.llm.scratch import cut


def test_stages_take_effect_and_keep_clean_documents(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    rng = random.Random(3)
    stock = {"en": "the and of thing with tion able", "de": "der und ung ich keit schaft wort"}

    def text(lang, n=80):
        return " ".join("".join(rng.choices(stock[lang].split(), k=2)) for _ in range(n))

    clean = [(i, text(lang), lang) for i, lang in enumerate(["en", "de"] * 30)]
    item, passage = text("en", 30), text("en", 60)
    rows = clean + [
        (100, clean[0][1], "en"), (101, clean[2][1] + " end", "en"), (102, None, "en"), (103, "12 34", "de"),
        (104, text("en") + " " + item, "en"), (105, text("en") + " " + passage, "en"), (106, passage + " " + text("en"), "en"),
    ]
    full = [(i, t, lang, "s", len(t or "")) for i, t, lang in rows]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, str(tmp_path)), name)
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        if name != "best_fit_packing":
            assert docs.columns == corpus_pipeline.COLUMNS
        if name == "substring_dedup":
            texts = {r.doc_id: r.text for r in docs.collect()}
    everyone = {r[0] for r in rows}
    assert kept["language_id"] == everyone - {102, 103}
    assert kept["ngram_jaccard_join"] == everyone - {102, 103, 100, 101}
    assert texts[105] == rows[-2][1] and passage not in texts[106] and texts[0] == clean[0][1]
    assert kept["benchmark_decontamination"] == kept["ngram_jaccard_join"] - {104}
    assert kept["best_fit_packing"] == kept["benchmark_decontamination"]


def test_stages_decide_on_rows_not_ids(spark, tmp_path):
    """Repeated rows, one id with different texts, and null ids."""
    pytest.importorskip("public_tokenizers")
    rng = random.Random(7)
    stock = "the and of thing with tion able".split()

    def text(n=80):
        return " ".join("".join(rng.choices(stock, k=3)) for _ in range(n))

    clean = [(i, text()) for i in range(40)]
    item, passage = text(30), text(60)
    other, bare, shared, second = text(), text(), text(), text(60)
    ordered = [(60 + i, f"{second} {text()}") for i in range(12)]  # of these the smallest id keeps the passage
    rows = clean + ordered + [
        (0, clean[0][1]), (0, clean[0][1]),  # repeated rows
        (5, clean[1][1]), (6, other),  # one id, other texts: a copy of another document, and a document
        (7, text() + " " + item),  # contaminated namesake of a clean row
        (None, bare), (None, bare), (None, clean[2][1]), (None, "12 34"), (None, text() + " " + item),  # null ids
        (50, passage + " " + shared), (50, text() + " " + passage), (None, text() + " " + passage),  # a passage under one id and none
    ]
    full = [(i, t, "en", "s", len(t)) for i, t in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(full, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = cut(stage(spark, docs, str(tmp_path)), name)
        kept[name] = sorted([(r.doc_id is None, r.doc_id, r.text) for r in docs.collect()], key=str)
    assert len(kept["language_id"]) == len(rows) - 1
    whole = sorted([(i is None, i, t) for i, t in {*rows} - {(5, clean[1][1]), (None, clean[2][1]), (None, "12 34")}], key=str)
    assert kept["ngram_jaccard_join"] == whole
    assert [i for _, i, t in kept["substring_dedup"] if passage in t] == [50] and [i for _, i, t in kept["substring_dedup"] if second in t] == [60]
    assert len(kept["substring_dedup"]) == len(whole)
    left = {(i, t) for _, i, t in kept["benchmark_decontamination"]}
    assert left >= {*clean, (6, other), (None, bare)} and len(left) == len(kept["benchmark_decontamination"]) == len(whole) - 2
    assert not any(item in t for _, t in left)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_of_an_empty_table(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_equal_brute_force(spark, tmp_path):
    """Each stage recomputed plainly on what its predecessor kept."""
    pytest.importorskip("public_tokenizers")
    rng = random.Random(23)
    stock = [f"w{chr(97 + i % 26)}{i}" for i in range(250)]
    base = [[rng.choice(stock) for _ in range(rng.choice([4, 30, 90, 160]))] for _ in range(40)]
    passage, items = [rng.choice(stock) for _ in range(64)], [[rng.choice(stock) for _ in range(n)] for n in (8, 20, 33)]
    rows = []
    for i, w in enumerate(base):
        rows.append(w)
        if i % 3 == 0:
            rows.append([x if rng.random() > 0.01 else "odd" for x in w])
        if i % 5 == 0:
            rows.append(w[:50] + passage + w[50:] + (rng.choice(items) if i % 2 else []))
    rng.shuffle(rows)
    full = [(i, " ".join(w), "en" if i % 4 else None, "s", 0) for i, w in enumerate(rows)] + [(900, None, "en", "s", 0), (901, "", "en", "s", 0), (902, "1 2 3", "en", "s", 0)]
    spark.createDataFrame(full, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, texts = spark.read.parquet(f"{tmp_path}/documents.parquet"), {i: t for i, t, *_ in full}

    def after(name):
        nonlocal docs
        docs = cut(dict(corpus_pipeline.STAGES)[name](spark, docs, str(tmp_path)), name)
        return {r.doc_id: r for r in docs.collect()}

    texts = {i: t for i, t in texts.items() if t and any(c.isalpha() for c in t)}
    got = after("language_id")
    assert {i: r.text for i, r in got.items()} == texts and {r.lang for r in got.values()} == {"en"}

    order = sorted(texts)
    roots = brute_components([texts[i] for i in order])
    texts = {i: texts[i] for n, i in enumerate(order) if roots[n][1] == n}
    assert {i: r.text for i, r in after("ngram_jaccard_join").items()} == texts

    first, words, cuts = {}, {i: t.split() for i, t in texts.items()}, {}
    for i in sorted(words):
        for p in range(len(words[i]) - 49):
            first.setdefault(tuple(words[i][p : p + 50]), i)
    for i, w in words.items():
        gone = {q for p in range(len(w) - 49) if first[tuple(w[p : p + 50])] < i for q in range(p, p + 50)}
        if len(gone) < len(w):
            cuts[i] = " ".join(x for q, x in enumerate(w) if q not in gone)
    assert cuts != texts
    got = after("substring_dedup")
    assert {i: r.text for i, r in got.items()} == cuts and all(r.n_chars == len(r.text) for i, r in got.items())

    def holds(doc, item):  # items stand whole or not at all here
        return any(doc[p : p + len(item)] == item for p in range(len(doc) - len(item) + 1))

    kept = {i: t for i, t in cuts.items() if not any(holds(t.split(), w) for w in items)}
    assert {i: r.text for i, r in after("benchmark_decontamination").items()} == kept != cuts
    packed = dict(corpus_pipeline.STAGES)["best_fit_packing"](spark, docs, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == set(kept) and len({(r.sequence_id, r.offset) for r in packed}) == len(packed)
