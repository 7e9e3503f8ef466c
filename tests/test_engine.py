"""Behaviour of the engine's own operators on hand-made inputs."""

import gzip
import hashlib
import json
import lzma
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from quillmill import cli, errors
from quillmill.functions import text as T
from quillmill.operators import chunk, curate, formats, generate, model, validate
from quillmill.operators import messages as M
from quillmill.plans import build
from quillmill.prompts import wording
from quillmill.providers import Completion, FakeProvider
from quillmill.sources import folders, readers

DOC = "seq long, source string, text string, sha256 string, index int"


def docs(spark, *texts, source="d.md"):
    return spark.createDataFrame([(i, source, t, "", 0) for i, t in enumerate(texts)], DOC)


def one(spark, expression, text):
    return spark.createDataFrame([(text,)], "t string").select(expression(F.col("t"))).first()[0]


def qa(rows):
    return [(r.messages[-2].content, r.messages[-1].content) for r in rows.orderBy("seq", "sub").collect()]


@pytest.mark.parametrize("text", ["", "plain words", "ß ẞ Straße", "é é ½ ‿_x 3.5", "a b c\x1cd\r\ne", "日本 한국 ΑΣ", "x" * 50])
def test_text_functions_follow_python(spark, text):
    tokens = re.findall(r"\w+|[^\w\s]", text)
    expected = 0 if not text else max(1, round(max(len(tokens) * 1.3, len(text) / 4)))
    assert one(spark, T.approx_tokens, text) == expected
    assert one(spark, T.lines, text) == text.splitlines()
    assert one(spark, T.collapse, text) == re.sub(r"\s+", " ", text).strip()
    assert one(spark, T.nfc, text) == unicodedata.normalize("NFC", text)
    assert one(spark, lambda t: T.casefold(t, full=True), text) == text.casefold()
    assert one(spark, T.words, text) == re.findall(r"\w+", text)


@pytest.mark.parametrize(("text", "expected"), [
    ("a\n\nb", ["a", "b"]), ("\n\na\n \nb\n\n", ["a", "b"]), ("a\n```\nx\n\ny\n```\nb\n\nc", ["a\n```\nx\n\ny\n```\nb", "c"]),
    ("a\n\n~~~\nopen\n\nend", ["a", "~~~\nopen\n\nend"]), ("", []), ("```\na\n\n~~~\n\nb", ["```\na\n\n~~~", "b"]),
])
def test_blocks(spark, text, expected):
    assert one(spark, T.blocks, text) == expected


def test_paragraph_packing(spark):
    text = "\n\n".join(["a" * 40, "b" * 40, "c" * 130, "d" * 10])
    got = chunk.paragraphs(docs(spark, text), max_chars=100, min_chars=20).orderBy("index").collect()
    assert [(r["index"], len(r["text"])) for r in got] == [(0, 82), (1, 130)]  # the short tail goes
    assert [r.text for r in chunk.paragraphs(docs(spark, "tiny"), 100, 20).collect()] == ["tiny"]
    with pytest.raises(ValueError):
        chunk.paragraphs(docs(spark, "x"), 0)
    assert chunk.no_chunks(docs(spark, " \n", "x")).count() == 1


def test_markdown_sections(spark):
    body = "word " * 20
    text = f"intro\n# Top #\n{body}\n## Part\n```\n# no heading\n```\n{body}\n# Other\nshort\n### Deep\n{body}"
    got = qa(generate.markdown_sections(docs(spark, text)))
    assert [q for q, _ in got] == ["Explain: Top.", "In the context of Top, explain: Part.", "In the context of Other, explain: Deep."]
    assert got[1][1].startswith("```\n# no heading")


def test_faq_markers_and_prose(spark):
    text = "Q: one\nmore?\n\nA: first answer that is long enough\n\nsecond block\n\nthird is out\nPergunta - dois?\nResposta: uma resposta bem longa aqui"
    assert qa(generate.faq_pairs(docs(spark, text))) == [("one more?", "first answer that is long enough\n\nsecond block"), ("dois?", "uma resposta bem longa aqui")]
    prose = "## **Why** so?\n\nBecause of a long enough reason.\n\nReally?\n\nSure?\n\nYes, really and truly so."
    assert qa(generate.faq_pairs(docs(spark, prose))) == [("Why so?", "Because of a long enough reason."), ("Sure?", "Yes, really and truly so.")]


def test_continuation_and_cloze(spark):
    text = " ".join(f"Sentence number {i} has quite a few words to be long enough." for i in range(9))
    got = qa(generate.continuation(docs(spark, text)))
    assert len(got) == 2 and got[0][1].startswith("Sentence number 3")
    blanks = qa(generate.cloze(docs(spark, text)))
    assert len(blanks) == 2 and all("____" in q for q, _ in blanks)
    assert blanks == qa(generate.cloze(docs(spark, text).repartition(3)))


def test_template_and_columns(spark):
    table = spark.createDataFrame([(0, "a", "b", None), (1, "c", "", "s")], "id long, Question string, answer string, system string")
    got = generate.template(table, skip_incomplete=True, seq="id").collect()
    assert [[m.content for m in r.messages] for r in got] == [["a", "b"]]
    with pytest.raises(Exception, match="empty side"):
        generate.template(table, seq="id").collect()
    with pytest.raises(errors.ConfigError):
        generate.template(table, user="{Question}")
    with pytest.raises(errors.ConfigError):
        generate.detect_columns(["messages"])
    assert generate.detect_columns(["instruction", "input", "output"]) == ("instruction", "output", "input")
    assert generate.for_source("x.CSV.gz") == "template" and generate.for_source("a.md") == "markdown"
    assert wording("PT_BR").lang == wording("pt").lang == "pt-br"
    with pytest.raises(errors.ConfigError):
        generate.create("nothing")


def examples(spark, *pairs):
    rows = spark.createDataFrame([(i, q, a) for i, (q, a) in enumerate(pairs)], "seq long, q string, a string")
    return rows.select("seq", F.lit(0).alias("sub"), F.lit("s").alias("source"), M.qa(F.col("q"), F.col("a")).alias("messages"))


def test_curation(spark):
    made = examples(spark, ("Q", "A  b"), ("q", "a b"), ("Q", "other"), ("x", "é \r\n\r\n\r\n\r\nend "))
    assert [r.seq for r in curate.dedup(made).orderBy("seq").collect()] == [0, 2, 3]
    assert [r.seq for r in curate.dedup(made, "user").orderBy("seq").collect()] == [0, 3]
    assert curate.normalize(made).where("seq = 3").first().messages[1].content == "é\n\nend"
    assert curate.min_length(made, 6).count() == 1
    kept, report = curate.run(made, curate.default_steps(max_tokens=100))
    assert report[0] == {"step": "normalize", "in": 4, "out": 4} and report[-1]["out"] == kept.count() == 3
    assert curate.split(made, 0.5).where("split = 'validation'").count() == 2
    assert curate.split(made, 0).where("split = 'train'").count() == 4
    with pytest.raises(ValueError):
        curate.split(made, 1)


def test_near_duplicates_are_greedy(spark):
    words = [f"w{i}" for i in range(200)]
    near = words.copy()
    near[100] = "other"
    made = examples(spark, ("q", " ".join(words)), ("q", " ".join(near)), ("q", "too short"), ("q", "too short"), ("q", " ".join(reversed(words))))
    assert [r.seq for r in curate.near_duplicate(made).orderBy("seq").collect()] == [0, 2, 3, 4]
    with pytest.raises(errors.ConfigError):
        curate.near_duplicate(made, permutations=10, bands=3)


BAD = [
    ("[1]", "data_type"), ('{"messages": []}', "missing_messages_list"), ('{"messages": [{"role":"user","content":"a","x":1},{"role":"assistant","content":"b"}]}', "message_unrecognized_key"),
    ('{"messages": [{"role":"bot","content":"a"},{"role":"assistant","content":"b"}]}', "unrecognized_role"), ('{"messages": [{"role":"user","content":" "},{"role":"assistant","content":"b"}]}', "missing_content"),
    ('{"messages": [{"role":"user","content":"a"}]}', "example_missing_assistant_message"), ('{"messages": [{"role":"assistant","content":"a"},{"role":"user","content":"b"}]}', "last_not_assistant"),
    ('{"messages": [{"role":"tool","content":"a"},{"role":"assistant","content":"b"}]}', "unsupported_tool_calls"), ("{bad", "invalid_json"), ('{"text": "x"}', "unknown_format"),
    ('{"messages": [{"role":"user","content":"a"},{"role":"assistant","content":"b","weight":true}]}', "invalid_weight"),
    ('{"messages": [{"role":"user","content":"a"},{"role":"system","content":"s"},{"role":"assistant","content":"b"}]}', "system_not_first"),
    ('{"conversations": [{"from":"alien","value":"a"}]}', "unrecognized_role"),
]
GOOD = '{"messages": [{"role":"user","content":"a"},{"role":"assistant","content":"b","weight":1.0}]}'


@pytest.mark.parametrize(("raw", "tag"), BAD)
def test_issue_tags(spark, raw, tag):
    rows = readers.parsed(spark.createDataFrame([("p", 1, raw)], "path string, line_no long, raw string"))
    assert rows.select(formats.record_issues(F.col("rec"), F.col("own"))).first()[0] == [tag]


def test_validate_convert_and_cli(spark, tmp_path, capsys):
    path = tmp_path / "d.jsonl"
    path.write_text("﻿" + "\n".join([b for b, _ in BAD] + ["", GOOD]) + "\n")
    report = validate.validate_jsonl(spark, str(path))
    assert (report.total, report.valid, report.ok) == (14, 1, False)
    assert report.invalid[0] == (1, ("data_type",)) and report.issues["unrecognized_role"] == 2 and "valid: 1" in report.summary()
    with pytest.raises(errors.ValidationError, match="d.jsonl:1"):
        readers.read_examples(spark, str(path))
    out = str(tmp_path / "o.jsonl")
    assert len(build.convert_jsonl(spark, str(path), out, "sharegpt", on_invalid="skip")) == 1
    assert json.loads(open(out).read()) == {"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]}
    assert cli.main(["validate", str(path)]) == 1 and cli.main(["validate", str(tmp_path / "none")]) == 2
    assert cli.main(["convert", out, "--out", str(tmp_path / "a.jsonl"), "--to", "alpaca"]) == 0


def test_readers_and_build(spark, tmp_path):
    body = "# Title\n" + "words " * 30
    (tmp_path / "a.md").write_text(body)
    (tmp_path / "b.md.gz").write_bytes(gzip.compress(body.replace("Title", "Zipped").encode()))
    (tmp_path / "c.md.xz").write_bytes(lzma.compress(body.replace("Title", "Packed").encode()))
    got = readers.read_documents(spark, [str(tmp_path / "a.md"), str(tmp_path), docs(spark, "mine")]).orderBy("seq").collect()
    assert [r.seq for r in got] == [0, 1, 2, 3] and got[0].source.endswith("a.md") and got[3].text == "mine" and len(got[0].sha256) == 64
    result = build.build_dataset(spark, [str(tmp_path / "*.md*")], str(tmp_path / "out"), generator="markdown", validation_fraction=0.4)
    counts = result.manifest["counts"]
    assert counts["generated"] == 3 and counts["validation"] == 1 and len(result) == 3
    assert len((tmp_path / "out/train.jsonl").read_text().splitlines()) == 2 and (tmp_path / "out/manifest.json").exists()
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe\xff")
    with pytest.raises(Exception, match="UTF-8"):
        readers.read_documents(spark, str(tmp_path / "bad.txt")).collect()
    (tmp_path / "t.csv").write_text('pergunta;resposta\n"a;b";c\nd;\n')
    assert [tuple(r) for r in readers.read_table(spark, str(tmp_path / "t.csv")).collect()] == [("a;b", "c"), ("d", "")]
    (tmp_path / "t.json").write_text('{"rows": [{"question": "x", "answer": "y"}]}')
    assert readers.read_table(spark, str(tmp_path / "t.json")).first().question == "x"


def test_model_generator(spark):
    def reply(talk):
        text = talk[0]["content"]
        if "broken" in text:
            return "no json"
        if "long" in text:
            return Completion("{", finish_reason="length")
        return '```json\n{"pairs": [{"question": "what fox", "answer": "quick brown jumps"}, {"question": "x", "answer": "unrelated nonsense entirely"}]}\n```'

    rows = docs(spark, "the quick brown fox jumps", "broken text here", "a long one", "  ")
    made, failed = model.generate_with_model(rows, lambda: FakeProvider(reply), prompts=wording("en"))
    assert qa(made) == [("what fox", "quick brown jumps")] and failed.count() == 2


def test_continuation_of_a_very_long_document(spark):
    """More blocks than once fitted a 32-bit place; all places differ."""
    block = " ".join(f"This is sentence number {i} and it is long enough to count." for i in range(4))
    made = generate.continuation(docs(spark, "\n\n".join([block] * 22_000)))
    assert made.count() == 22_000 == made.select("seq", "sub").distinct().count()


def test_keys_are_unique_over_chunks(spark):
    """A passage repeated in another document's second chunk goes, and nothing else."""
    para = [" ".join(f"{w}{i} is a word of sentence {i}." for i in range(30)) for w in "abc"]
    cut = chunk.paragraphs(docs(spark, "\n\n".join(para[:2]), "\n\n".join([para[2], para[0]])), max_chars=300, min_chars=10)
    made = generate.continuation(cut)
    assert made.count() == made.select("seq", "sub").distinct().count()
    whole = cut.select("seq", generate.place(F.lit(0)).alias("sub"), "source", M.qa(F.lit("q"), F.col("text")).alias("messages"))
    assert whole.count() == 4 and curate.dedup(whole).count() == 3 and curate.near_duplicate(whole, roles=("assistant",)).count() == 3


def test_fingerprints_compose(spark):
    made = examples(spark, ("q", "café au lait"), ("q", "café  au LAIT"), ("q", "cafe au lait"))
    assert sorted(r.seq for r in curate.dedup(made).collect()) == [0, 2]


def test_near_duplicates_of_a_large_group(spark):
    """Exact and near copies in one band: heads drop them, whatever the pairs; a plain greedy pass agrees."""
    import random

    from quillmill.operators import near

    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(160):
        w = base.copy()
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            w[rng.randrange(120)] = f"x{rng.randrange(10)}"
        texts.append(" ".join(w))
    made = examples(spark, *(("q", t) for t in texts))
    signed = {r.seq: r.sig for r in made.select("seq", near.signatures(5, 64)(F.get("messages", 1)["content"]).alias("sig")).collect()}
    kept = []
    for i in range(160):
        same = lambda j: sum(a == b for a, b in zip(signed[i], signed[j])) / 64  # noqa: B023, E731
        band = lambda j: any(signed[i][b : b + 4] == signed[j][b : b + 4] for b in range(0, 64, 4))  # noqa: B023, E731
        if not any(band(j) and same(j) >= 0.9 for j in kept):
            kept.append(i)
    assert 1 < len(kept) < 100
    for dense in (near.DENSE, 0):
        near.DENSE, old = dense, near.DENSE
        try:
            assert sorted(r.seq for r in curate.near_duplicate(made, roles=("assistant",)).collect()) == kept
        finally:
            near.DENSE = old


def test_split_takes_the_smallest_ranks(spark):
    made = examples(spark, *(("q", f"answer {i}") for i in range(300)))
    for fraction in (0.01, 0.3, 0.999):
        train, validation = curate.split_examples(made, fraction)
        assert validation.count() == max(1, int(300 * fraction)) and train.count() + validation.count() == 300
    assert curate.split(made.limit(1), 0.5).first().split == "train" and curate.split(made.limit(0), 0.5).count() == 0


def test_compressed_tables_and_recursive_globs(spark, tmp_path):
    body = "pergunta;resposta\n\"a;\nb\";c\nd;\n".encode()
    for name, pack in (("t.csv.xz", lzma.compress), ("t.csv.gzip", gzip.compress), ("t.csv.gz", gzip.compress)):
        (tmp_path / name).write_bytes(pack(body))
        assert [tuple(r) for r in readers.read_table(spark, str(tmp_path / name)).collect()] == [("a;\nb", "c"), ("d", "")], name
    for name, pack in (("t.jsonl.xz", lzma.compress), ("t.jsonl.gz", gzip.compress)):
        (tmp_path / name).write_bytes(pack(b'{"question": "x", "answer": "y"}\n'))
        assert readers.read_table(spark, str(tmp_path / name)).first().question == "x"
    deep = tmp_path / "in" / "a" / "b"
    deep.mkdir(parents=True)
    for path in (tmp_path / "in" / "x.md", deep / "y.md", deep / "z.txt"):
        path.write_text("text")
    got = readers.read_documents(spark, str(tmp_path / "in/**/*.md")).collect()
    assert sorted(r.source.rpartition("/")[2] for r in got) == ["x.md", "y.md"]
    with pytest.raises(FileNotFoundError):
        readers.read_documents(spark, str(tmp_path / "in/**/*.none"))


def test_jsonl_lines_over_files_and_splits(spark, tmp_path):
    for name, n in (("a.jsonl", 3000), ("b.jsonl.gz", 40), ("c.jsonl.xz", 5)):
        text = "".join(json.dumps({"messages": [{"role": "user", "content": f"{name}{i}"}, {"role": "assistant", "content": "x" * 50}]}) + "\n" + "\n" * (i % 7 == 0) for i in range(n)).encode()
        (tmp_path / name).write_bytes({"gz": gzip.compress, "xz": lzma.compress}.get(name.rpartition(".")[2], bytes)(text))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40k")
    try:
        lines = readers.read_jsonl(spark, str(tmp_path))
        for r in lines.select("path", "line_no", F.get_json_object("raw", "$.messages[0].content").alias("c")).collect():
            name, i = re.fullmatch(r"(.*?(?:jsonl|gz|xz))(\d+)", r.c).groups()
            assert r.path.endswith(name) and r.line_no == int(i) + 1 + (int(i) + 6) // 7
        made = readers.read_examples(spark, str(tmp_path))
        assert made.count() == 3045 == made.select("seq").distinct().count()
        assert [r.messages[0].content for r in made.orderBy("seq").limit(2).collect()] == ["a.jsonl0", "a.jsonl1"]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    (tmp_path / "bad.jsonl").write_bytes(b"\xff\xfe\n")
    with pytest.raises(errors.FormatError, match="UTF-8"):
        readers.read_jsonl(spark, str(tmp_path / "bad.jsonl"))


def test_template_specs_and_attributes(spark):
    table = spark.createDataFrame([(1, "a", 2.5, ("v",)), (2, None, 3.0, ("w",))], "id int, name string, price double, more struct<k:string>")
    assert [r[0] for r in table.select(generate.rendered("{name:>3}|{price:.2f}|{more[k]}|{id!r}|{{x}}", table.columns)).collect()] == ["a|2.50|v|1|{x}", "|3.00|w|2|{x}"]
    for bad in ("{none}", "{", "{name.x} {no:3}"):
        with pytest.raises(errors.ConfigError):
            generate.rendered(bad, table.columns)


def test_build_results_hold_all_sources_and_errors(spark):
    rows = docs(spark, *("# T\n" + "w " * 60 for _ in range(3)))
    result = build.build_dataset(spark, rows, generator="markdown")
    assert result.sources.count() == 3 and result.errors is None


def test_streamed_dedup(spark, tmp_path):
    from quillmill.streaming.dedup import dedup_stream

    rows = spark.createDataFrame([("café A",), ("café  a",), ("b",)], "told string").withColumn("at", F.timestamp_seconds(F.lit(1000)))
    rows.write.parquet(f"{tmp_path}/in")
    stream = dedup_stream(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), "told", "at")
    query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2


def test_folders_of_many_files_are_listed_and_read_by_tasks(spark, tmp_path, monkeypatch):
    rows = [(f"{i % 7}/doc={i}", f"text {i}é") for i in range(300)] + [("3/doc=3", "of the same folder"), ("4/none", None)]
    folders.write_texts(spark.createDataFrame(rows, "place string, text string").repartition(3), str(tmp_path / "in"))
    for hidden in ("_left/x.txt", ".left/x.txt", "1/_x.txt"):
        (tmp_path / "in" / hidden).parent.mkdir(exist_ok=True)
        (tmp_path / "in" / hidden).write_bytes(b"\xff")
    (tmp_path / "in" / "zipped.txt.gz").write_bytes(gzip.compress(b"\xef\xbb\xbfpacked"))
    monkeypatch.setattr(readers, "_files", None)  # a driver's own listing is not used
    got = readers.read_documents(spark, [docs(spark, "mine"), str(tmp_path / "in"), f"file:{tmp_path / 'in'}"]).orderBy("seq").collect()
    assert [r.seq for r in got] == list(range(304)) and got[0].text == "mine"
    assert [r.source for r in got[1:]] == sorted(r.source for r in got[1:]) and got[-1].text == "packed"
    assert sorted(r.text for r in got[1:-1]) == sorted(f"{t or ''}\n" for _, t in rows)
    assert all(r.sha256 == hashlib.sha256(open(r.source, "rb").read()).hexdigest() for r in got[1:])
    (tmp_path / "empty").mkdir()
    with pytest.raises(FileNotFoundError):
        readers.read_documents(spark, str(tmp_path / "empty"))


ODD = ["", "  Plain \t\x1c words\x1e ", "é É ß ẞ İ ﬁ ΑΣ", "﷐ kept ﷐", "a  \r\n\r\n\n\n b \t\r c\t  ", "x  ý"]


def regular_expressions(frame):
    plan = frame._jdf.queryExecution().optimizedPlan().toString().lower()
    return plan.count("regexp") + plan.count("rlike")


def test_fingerprints_need_no_regular_expressions(spark):
    rows = spark.createDataFrame([(i, [("user", "Q", None, None), ("assistant", t, None, None), ("tool", "left out", None, None)]) for i, t in enumerate(ODD)] + [(99, None)], f"seq long, messages array<{M.MESSAGE}>")
    made = rows.select("seq", M.fingerprint(F.col("messages")).alias("fp"))
    got = dict(made.collect())
    for i, t in enumerate(ODD):
        told = unicodedata.normalize("NFC", f"user\x1fQ\x1eassistant\x1f{re.sub(r'\s+', ' ', t).strip()}\x1e").casefold()
        assert got[i] == hashlib.sha256(told.encode()).hexdigest()
    assert got[99] is None and not regular_expressions(made)
    bad = rows.select(M.fingerprint(F.array(M.message("user", F.expr("cast(X'61FF62' as string)")))).alias("fp")).first()[0]
    assert bad == hashlib.sha256("user\x1fa�b\x1e".encode()).hexdigest()


def test_normalize_keeps_contents_with_marks_apart(spark):
    rows = spark.createDataFrame([(i, 0, "s", [("user", t, None, None), ("assistant", f"after {t}", "n", 1), ("system", None, None, None)]) for i, t in enumerate(ODD)], f"seq long, sub int, source string, messages array<{M.MESSAGE}>")
    made = curate.normalize(rows)
    assert not regular_expressions(made)
    for r in made.collect():
        plain = [spark.range(1).select(curate.normal_content(F.lit(x))).first()[0] for x in (ODD[r.seq], f"after {ODD[r.seq]}")]
        assert [m.content for m in r.messages] == [*plain, ""] and [m.name for m in r.messages] == [None, "n", None]


def test_grounding_needs_no_regular_expressions(spark):
    rows = spark.createDataFrame([("Straße word9 odd", "STRASSE here"), ("no at all", "word"), ("words only", "other text"), (None, "a b"), (None, "words"), ("a b", None)], "a string, s string")
    made = rows.select(curate.grounded(F.col("a"), F.col("s")).alias("g"))
    assert [r.g for r in made.collect()] == [True, True, False, True, None, True] and not regular_expressions(made)


def test_build_files_reads_no_dataset_in_one_task(spark, tmp_path):
    rows = spark.range(4000).select(F.col("id").alias("seq"), F.lit(0).alias("sub"), F.lit("s").alias("source"), M.qa(F.lit("q"), F.concat(F.lit("a"), F.col("id").cast("string"))).alias("messages"))
    made = build.build_examples(rows, str(tmp_path / "data.jsonl"), steps=[], validation_fraction=0.2, single_file=False)
    for told, name in zip(made.manifest["output"]["files"], ("data.jsonl", "data.validation.jsonl"), strict=True):
        assert told["name"] == name and sum(p["records"] for p in told["files"]) == told["records"]
        assert all(p["sha256"] == hashlib.sha256((tmp_path / name / p["name"]).read_bytes()).hexdigest() for p in told["files"])
