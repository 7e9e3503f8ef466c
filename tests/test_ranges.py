"""CSV cells over lines, JSON arrays and formats by file, read in many small splits."""

import csv
import io
import json
import random

import pytest

from quillmill.errors import FormatError
from quillmill.sources import ranges, readers


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.fixture(scope="module")
def objects():
    rng = random.Random(1)
    made = []
    for i in range(150):
        o = {"id": i, "it's": rng.choice(['a"b', "x}y{", "\\", 'q\\"}', "[", "é\n}", ""]), "b[0]": {"c": [1, {"d": "}"}]} if i % 3 else None, "t": rng.choice([True, 1.5, 1.0, "s", None])}
        if i % 7 == 0:
            del o["t"]
        made.append(o)
    return made


def cells(objects):
    def told(v):
        return v if v is None or isinstance(v, str) else json.dumps(v, separators=(",", ":"), ensure_ascii=False)

    return [tuple(told(o.get(k)) for k in sorted(["id", "it's", "b[0]", "t"])) for o in objects]


@pytest.mark.parametrize("shape", ["one line", "many lines", "wrapped", "wrapped lines"])
def test_json_objects(small_splits, objects, tmp_path, shape):
    text = {
        "one line": lambda: json.dumps(objects, separators=(",", ":"), ensure_ascii=False),
        "many lines": lambda: json.dumps(objects, indent=2) + "\n\n",
        "wrapped": lambda: json.dumps({"meta": {"a": {"b": [{"z": 1}]}, "items": []}, "other": [{"id": "no"}, {"id": "no"}], "data": objects, "rows": [{"q": 1}]}),
        "wrapped lines": lambda: "\ufeff" + json.dumps({"rows": objects}, indent=1) + "\n",
    }[shape]()
    (tmp_path / "t.json").write_text(text)
    assert ranges.pieces(small_splits, str(tmp_path / "t.json"), "}").select("split").distinct().count() > 2
    got = readers.read_table(small_splits, str(tmp_path / "t.json"))
    assert got.columns == sorted(["id", "it's", "b[0]", "t"]) and [tuple(r) for r in got.collect()] == cells(objects)


def test_json_that_is_no_table(spark, tmp_path):
    for bad in ('[1,{"a":1}]', '[{"a":1},2]', '{"a":1}', '{"data":{"x":[{"a":1}]}}', '[{"a":}]', '[{"a":1}', "nope", '[[{"a":1}]]', '{"data":[[{"a":1}]]}', '"x"'):
        (tmp_path / "bad.json").write_text(bad)
        with pytest.raises(FormatError):
            readers.read_table(spark, str(tmp_path / "bad.json"))
    for empty in ("[]", '{"data":[]}', '{"data":[],"rows":[{"a":1}]}'):
        (tmp_path / "empty.json").write_text(empty)
        assert readers.read_table(spark, str(tmp_path / "empty.json")).columns == []


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_csv_cells_over_lines(small_splits, tmp_path, end):
    rng = random.Random(2)
    out = io.StringIO()
    some = ["plain", "li\nne", "com,ma", 'qu"ote', '"', "\n\n", '5" pipe', "", 'a"\n"b']
    csv.writer(out, lineterminator="\n").writerows([["q", "a", "n,x"], *([rng.choice(some) for _ in range(3)] for _ in range(300))])
    text = out.getvalue() + '5" pipe,"x\ny",z"q\n\nshort\n' + 'last,"never\nclosed'
    want = [tuple((r + ["", ""])[:3]) for r in list(csv.reader(io.StringIO(text)))[1:] if r]
    (tmp_path / "t.csv").write_bytes(text.replace("\n", end).encode())
    assert ranges.pieces(small_splits, str(tmp_path / "t.csv")).select("split").distinct().count() > 1
    got = readers.read_table(small_splits, str(tmp_path / "t.csv"))
    assert got.columns == ["q", "a", "n,x"] and [tuple(r) for r in got.collect()] == want


def test_formats_are_pinned_by_file(spark, tmp_path):
    chat = '{"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]}'
    share = '{"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]}'
    (tmp_path / "a.jsonl").write_text("\n".join(["bad", chat, chat, share]))
    (tmp_path / "b.jsonl").write_text("\n".join([share, share, chat]))
    got = readers.read_examples(spark, str(tmp_path), on_invalid="skip")
    assert sorted((r.seq >> 40, r.seq % 2**40) for r in got.collect()) == [(0, 2), (0, 3), (1, 1), (1, 2)]
    assert [(r.path[-7:], r.line_no) for r in readers.rejected(spark, str(tmp_path)).orderBy("path", "line_no").collect()] == [("a.jsonl", 1), ("a.jsonl", 4), ("b.jsonl", 3)]
    lines = readers.read_jsonl(spark, str(tmp_path)).drop("path")
    assert readers.pinned(lines.where("line_no < 2")).count() == 2
