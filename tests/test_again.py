"""Builds that know earlier ones, replies that are kept, and counts taken while rows pass."""

import os
import pickle
import re
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

import quillmill
from quillmill import providers as P
from quillmill.functions import counters
from quillmill.functions import text as T
from quillmill.operators import curate, model
from quillmill.operators import messages as M
from quillmill.operators import seen as seen_of
from quillmill.operators.seen import Seen
from quillmill.plans import build


def examples(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "seq long, text string")
    return rows.select("seq", F.lit(0).cast("long").alias("sub"), F.lit("s").alias("source"), M.qa(F.lit("ask"), F.col("text")).alias("messages"))


def test_fresh_rows_of_later_builds(spark, tmp_path):
    """Two builds keep a text once, whatever its letters' case; a build that fails adds nothing; the sieve loses no row."""
    folder = str(tmp_path / "seen")
    first = build.build_examples(examples(spark, ["one text here", "two", "two"]), seen=folder)
    assert first.counts["kept"] == 2
    later = examples(spark, ["TWO ", "three", *(f"new {i}" for i in range(500))])
    with pytest.raises(Exception):
        build.build_examples(later, steps=[("bad", lambda df: df.where(F.raise_error(F.lit("no"))))], seen=folder)
    second = build.build_examples(later, seen=folder)
    assert second.counts["kept"] == 501 and second.report[-1] == {"step": "unseen", "in": 502, "out": 501}
    assert build.build_examples(later, seen=folder).counts["kept"] == 0
    assert Seen(folder).known(spark).count() == 503
    assert Seen(str(tmp_path / "none")).fresh(later).count() == 502


def test_builds_with_a_folder_of_fingerprints_write_rows_once(spark, tmp_path, monkeypatch):
    """Rows are written once, or twice where a table is known; fingerprints are made once, and joined without rows."""
    written, printed = [], []
    for module in (build, curate, seen_of):
        monkeypatch.setattr(module, "cut", lambda df, name="t", *a, f=module.cut: written.append((name, df.columns)) or f(df, name, *a))
    monkeypatch.setattr(M, "fingerprint", lambda *a, f=M.fingerprint: printed.append(a) or f(*a))
    made, folder = examples(spark, ["one", "one", "two", "three"]), str(tmp_path / "seen")
    assert build.build_examples(made, seen=folder).counts["kept"] == 3
    assert [name for name, _ in written] == ["curated"] and len(printed) == 1
    written.clear()
    more = examples(spark, ["two", "four", "five"]).select("seq", M.fingerprint(F.col("messages")).alias("told"))
    assert {r.seq for r in Seen(folder).fresh(more, "told").collect()} == {1, 2}
    assert written[0] == ("fingerprinted", ["seq", "told", "_may"]) and written[1] == ("new", ["_new"])
    again = build.build_examples(examples(spark, ["TWO", "four", "six", "six"]), seen=folder, steps=[("dedup", curate.dedup), ("min_length", lambda df: df.where("seq < 9"))])
    assert again.counts["kept"] == 2 and again.train.columns == ["seq", "sub", "source", "messages"] and Seen(folder).known(spark).count() == 5


def test_rows_that_a_full_sieve_lets_through_stay(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(seen_of, "BITS_MOST", 64)
    for known in (7, 100):  # a sieve with many false hits; none
        folder = str(tmp_path / str(known))
        Seen(folder).remember(examples(spark, [f"old {i}" for i in range(known)]))
        rows = examples(spark, [*(f"old {i}" for i in range(known)), *(f"new {i}" for i in range(300))])
        assert {r.seq for r in Seen(folder).fresh(rows).collect()} == set(range(known, known + 300))
        rows = rows.select("seq", F.when(F.col("seq") < known + 9, M.fingerprint(F.col("messages"))).alias("fp"))  # null is new
        assert {r.seq for r in Seen(folder).fresh(rows, "fp").collect()} == set(range(known, known + 300))


def test_fake_providers_of_workers_keep_no_texts():
    """A record of calls grew with all texts of a task; replies still come in turn."""
    talk = [{"role": "user", "content": "x" * 99}]
    for fake in (P.FakeProvider(["a", "b"], record=False), pickle.loads(pickle.dumps(P.FakeProvider(["a", "b"])))):
        assert [fake.complete(talk).text for _ in range(3)] == ["a", "b", "b"] and fake.calls == [] and fake.number == 3
    here = P.FakeProvider(["a", "b"])
    assert here.complete(talk).text == "a" and len(here.calls) == 1 and pickle.loads(pickle.dumps(here)).complete(talk).text == "b"


def test_journals_hold_keys_of_earlier_attempts(tmp_path, monkeypatch):
    monkeypatch.setattr(model.TaskContext, "get", lambda: SimpleNamespace(partitionId=lambda: 3, attemptNumber=lambda: 1))
    first = model.Journal(str(tmp_path), "run")
    for i in range(3):
        first.add({"key": f"k{i}", "pairs": [["é\u2028\r", "b" * 999]], "error": None})
    first.out.write(b'{"key": "cut')
    first.out.close()
    (tmp_path / "run-4-0-x.jsonl").write_text('{"key": "other"}\n')
    assert model.Journal(str(tmp_path), "run").known == {"k0", "k1", "k2"}


def test_tokens_counted_by_batches_are_those_of_the_pattern(spark, monkeypatch):
    texts = ["", " ", "a", "_a1 b-c\n", "Größe: 3½ €!", "漢字 x́ \u2028٣a", "🙂🙂 a🙂b", "\x1c\x85\xa0.", "word " * 50 + "end"]
    rows = spark.createDataFrame([(texts + [None],)], "t array<string>")
    got = rows.select(counters.APPROX.sizes(F.col("t")).alias("a"), F.transform("t", lambda x: F.coalesce(T.approx_tokens(x), F.lit(0))).alias("b")).first()
    assert got.a == got.b and got.a[0] == 0 and got.a[-1] == 0
    assert "ArrowEvalPython" in rows.select(counters.APPROX.total(F.col("t")))._jdf.queryExecution().toString()
    monkeypatch.setattr(counters, "SLICE", 3)
    assert [counters._pieces(x) for x in texts] == [len(re.findall(r"\w+|[^\w\s]", x)) for x in texts]


def test_one_spaced():
    for text in ("", " ", "a", "\t a\n\n b\x1c\x1d", "a\xa0\u2003 \u3000b ", "x" + "".join(map(chr, range(0x3002))) + "y", "  " * 999 + "é" + " " * 77 + "z"):
        assert T.one_spaced(text) == " ".join(text.split())


def test_counts_are_taken_in_one_write(spark, monkeypatch):
    written = []
    monkeypatch.setattr(curate, "cut", lambda df, name, *a: written.append(name) or df.sparkSession.createDataFrame(df.collect(), df.schema))
    monkeypatch.setattr(curate, "discard", lambda df: None)
    made = examples(spark, ["a" * 30, "a" * 30, "b", "c" * 40])
    kept, report = curate.run(made, [("normalize", curate.normalize), ("dedup", curate.dedup), ("min_length", curate.min_length)])
    assert written == ["curated"] and kept.count() == 2
    assert [(r["step"], r["in"], r["out"]) for r in report] == [("normalize", 4, 4), ("dedup", 4, 3), ("min_length", 3, 2)]
    written.clear()
    _, report = curate.run(made, [("normalize", curate.normalize), ("own", lambda df: df.limit(3)), ("dedup", curate.dedup)])
    assert written == ["examples", "curated"] and report[1] == {"step": "own", "in": 4, "out": 3}
    assert curate.run(made, [])[1] == [{"step": "none", "in": 4, "out": 4}]


class Counting:
    """Writes a line for each call, and breaks at one text while a file is there."""

    def __init__(self, folder):
        self.folder = folder

    def complete(self, messages, schema=None, temperature=0.0):
        text = messages[-1]["content"]
        if "chunk 7" in text and os.path.exists(f"{self.folder}/broken"):
            raise RuntimeError("the machine is lost")
        with open(f"{self.folder}/calls", "a") as f:
            f.write("call\n")
        if "chunk 5" in text:
            return P.Completion("no json", "stop")
        return P.Completion('{"pairs": [{"question": "What?", "answer": "grounded words"}]}', "stop")


def test_a_task_that_is_lost_asks_again_only_for_the_rest(spark, tmp_path):
    folder, store = str(tmp_path), str(tmp_path / "replies")
    chunks = spark.createDataFrame([(i, "s", f"grounded words chunk {i % 12}", "", 0) for i in range(24)], "seq long, source string, text string, sha256 string, index int").coalesce(1)

    def ask(**more):
        return model.generate_with_model(chunks, lambda: Counting(folder), max_retries=0, replies=store, **more)

    def calls():
        with open(f"{folder}/calls") as f:
            return len(f.readlines())

    (tmp_path / "broken").touch()
    with pytest.raises(Exception, match="lost"):
        ask()
    before = calls()
    (tmp_path / "broken").unlink()
    made, errors = ask()
    assert made.count() == 22 and {r.error for r in errors.collect()} == {"no usable JSON in the reply"} and errors.count() == 2
    assert before < 12 <= calls() <= 13  # only a failed chunk may be asked twice
    ask()
    assert calls() <= 14  # a run with the same words asks for what failed alone
    ask(model_name="another")
    assert calls() >= 24


def test_values_and_frames(spark):
    """Documents and examples as Python values, to frames and back; a role is one of three."""
    one = quillmill.Example((quillmill.Message("user", "a"), quillmill.Message(quillmill.Role.ASSISTANT, "b", weight=1)), "s", 0)
    assert [quillmill.Example.of(r) for r in quillmill.examples_frame(spark, [one]).collect()] == [one]
    docs = quillmill.read_documents(spark, quillmill.documents_frame(spark, [quillmill.Document("x y", "here")]))
    assert [(r.text, r.source) for r in docs.collect()] == [("x y", "here")]
    with pytest.raises(ValueError):
        quillmill.Message("robot", "a")


def test_fingerprints_fold_fully(spark):
    """Equal up to case by the full table, composed or not."""
    pairs = [("ſtraße", "STRASSE"), ("ΑΣ", "ας"), ("ﬁne", "FINE"), ("µ", "Μ"), ("e\u0301", "É"), ("ǰ", "J\u030c")]
    texts = [x for p in pairs for x in p]
    kept = curate.dedup(examples(spark, texts)).count()
    assert kept == len(pairs)
