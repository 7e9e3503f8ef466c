"""Counters, settings, providers, build options and the command line."""

import functools
import io
import json
import types

import pytest
from pyspark.sql import functions as F

from quillmill import cli, errors, providers
from quillmill.config import Environment, web_address
from quillmill.functions import text as T
from quillmill.functions.counters import APPROX, Counter, get_counter
from quillmill.operators import chunk, curate, formats, validate
from quillmill.operators import messages as M
from quillmill.plans import build
from quillmill.providers import Completion, FakeProvider
from quillmill.sources import sinks

DOC = "seq long, source string, text string, sha256 string, index int"
LETTERS = Counter("letters", lambda strings: F.transform(strings, lambda x: F.coalesce(F.length(x), F.lit(0))))


def docs(spark, *texts):
    return spark.createDataFrame([(i, f"d{i}.md", t, "", 0) for i, t in enumerate(texts)], DOC)


@pytest.fixture
def tokenizer_file(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    made = Tokenizer(models.WordLevel({"[unk]": 0, "a": 1, "b": 2}, unk_token="[unk]"))
    made.pre_tokenizer = pre_tokenizers.Whitespace()
    made.save(str(tmp_path / "t.json"))
    return str(tmp_path / "t.json")


def test_counters(spark, tokenizer_file):
    row = spark.createDataFrame([("q", "a b, ccc", "n")], "q string, a string, n string")
    talk = F.array(
        F.struct(F.lit("user").alias("role"), F.col("q").alias("content"), F.col("n").alias("name"), F.lit(None).cast("int").alias("weight")),
        M.message("assistant", F.col("a")),
    )
    exact = get_counter(f"tokenizer:{tokenizer_file}")
    got = row.select(M.example_tokens(talk, LETTERS), M.assistant_tokens(talk, exact), M.example_tokens(talk), exact.count(F.lit("")), exact.count(F.lit(None).cast("string"))).first()
    # three, twice three, one for the name, and the strings: user, q, n, assistant, "a b, ccc"
    assert got[0] == 3 + 6 + 1 + 4 + 1 + 1 + 9 + 8 and got[1] == 4 and tuple(got[3:]) == (0, 0)
    assert got[2] == 3 + 6 + 1 + 1 + 1 + 1 + 2 + 5
    assert get_counter(None) is get_counter(" Approx ") is APPROX and get_counter(LETTERS) is LETTERS
    assert get_counter("tiktoken").name == "tiktoken:cl100k_base"
    for bad in ("words", "approx:x", "tokenizer:", 3):
        with pytest.raises(errors.ConfigError):
            get_counter(bad)
    text = "\n\n".join(["a b", "a b a", "b"])
    cut = chunk.windows(docs(spark, text), max_tokens=4, min_tokens=1, counter=exact).orderBy("index")
    assert [r.text for r in cut.collect()] == ["a b", "a b a", "b"]
    made = row.select(F.lit(0).alias("seq"), F.lit(0).alias("sub"), F.lit("s").alias("source"), talk.alias("messages"))
    assert [curate.token_budget(made, got[0] + d, LETTERS).count() for d in (0, -1)] == [1, 0]
    assert row.select(T.approx_tokens(F.lit(None).cast("string"))).first()[0] is None


def test_null_content_keeps_its_place(spark):
    row = spark.createDataFrame([(0, None, " b ")], "seq long, q string, a string")
    made = row.select("seq", F.lit(0).alias("sub"), F.lit("s").alias("source"), M.qa(F.col("q"), F.col("a")).alias("messages"))
    assert [m.content for m in curate.normalize(made).first().messages] == ["", "b"]


def test_settings():
    got = Environment({"QUILLMILL_PROVIDER": " OpenAI ", "OLLAMA_HOST": "box:1/", "GOOGLE_API_KEY": "g", "GEMINI_API_KEY": " ", "OPENAI_API_KEY": ""})
    assert (got.provider, got.url("ollama"), got.key("openai"), got.own_url("openai"), got.key("gemini")) == ("openai", "http://box:1", None, None, "g")
    assert got.model("openai") == "gpt-4o-mini" and Environment({"QUILLMILL_MODEL": "m"}).model("openai") == "m" and got.model("own") == ""
    assert Environment({}).url("ollama") == "http://localhost:11434" and Environment({}).provider == "ollama" and web_address("https://x/") == "https://x"


def test_providers():
    fake = FakeProvider(["one", ValueError("no"), lambda m: m[0]["content"]])
    talk = [{"role": "user", "content": "hello"}]
    assert fake.complete(talk).text == "one"
    with pytest.raises(ValueError):
        fake.complete(talk)
    assert fake.complete(talk).text == fake.complete(talk).text == "hello" and len(fake.calls) == 4
    with pytest.raises(errors.ProviderError):
        FakeProvider([]).complete(talk)
    seen = {}

    def answer(**given):
        seen.update(given)
        reason = types.SimpleNamespace(name="MAX_TOKENS")
        return types.SimpleNamespace(text="ok", usage_metadata=None, candidates=[types.SimpleNamespace(finish_reason=reason)])

    client = types.SimpleNamespace(models=types.SimpleNamespace(generate_content=answer))
    gemini = providers.GeminiProvider("m", client=client)
    got = gemini.complete([{"role": "system", "content": "s"}, *talk, {"role": "assistant", "content": "x"}], {"type": "object"})
    assert got.text == "ok" and got.finish_reason == "length" and seen["config"]["system_instruction"] == "s"
    assert [c["role"] for c in seen["contents"]] == ["user", "model"] and "response_json_schema" in seen["config"]
    for bad in (lambda: providers.GeminiProvider("m"), lambda: providers.create("nobody"), lambda: providers.create("openai", settings=Environment({}))):
        with pytest.raises(errors.ConfigError):
            bad()
    providers.register("echo", lambda model, settings, **o: FakeProvider(lambda m: model))
    assert providers.create("echo", "big").complete(talk).text == "big" and "echo" in providers.available()
    assert [providers.Server("h", v, ()).takes_schema for v in ("0.5.0", "dev", "0.4.9-rc1")] == [True, True, False]

    def opener(request, timeout):
        return io.BytesIO(b'{"version": "0.9.1"}' if request.full_url.endswith("version") else b'{"models": [{"name": "m"}]}')

    assert providers.probe("box", opener) == providers.Server("http://box", "0.9.1", ("m",))

    def down(request, timeout):
        raise OSError("down")

    assert providers.probe("box", down) is None


def _reply(talk):
    if "broken" in talk[0]["content"]:
        return "no json"
    return '{"pairs": [{"question": "what fox", "answer": "quick brown jumps"}]}'


def test_model_build_lists_or_raises_errors(spark, tmp_path):
    rows = docs(spark, "the quick brown fox jumps", "broken text here")
    start = functools.partial(build.build_dataset, spark, rows, generator="llm-qa", provider=FakeProvider(_reply), system_prompt="be brief")
    result = start(str(tmp_path / "out"), write_lineage=True)
    assert result.counts == {"generated": 1, "kept": 1, "train": 1, "validation": 0, "errors": 1}
    assert result.manifest["errors"][0]["source"].startswith("d1.md") and len(result.manifest["generator"]["params"]["prompts"]) == 64
    assert result.manifest["chunker"] == {"name": "paragraphs"} and [s["source"] for s in result.manifest["sources"]] == ["d0.md", "d1.md"]
    assert [m.role for m in result.train.first().messages] == ["system", "user", "assistant"]
    assert [json.loads(x) for x in open(tmp_path / "out/lineage.jsonl")] == [{"split": "train", "index": 0, "source": "d0.md#0"}]
    with pytest.raises(errors.GenerationError, match="d1.md"):
        start(on_error="raise")
    with pytest.raises(ValueError):
        start(on_error="ignore")


def test_builder_takes_functions_and_writers(spark, tmp_path):
    def shout(chunks):
        return chunks.select("seq", F.lit(0).alias("sub"), "source", M.qa(F.col("text"), F.upper("text")).alias("messages"))

    rows = docs(spark, "a", "b", "c", "c")
    kept, report = build.DatasetBuilder(shout).examples(rows)
    assert kept.count() == 3 and [r["step"] for r in report] == ["normalize", "dedup"]
    writer = sinks.InMemoryWriter("alpaca")
    made = build.DatasetBuilder(shout, writer=writer, steps=[], token_counter=LETTERS, validation_fraction=0.5)
    result = made.build(rows, str(tmp_path / "out"))
    assert result.counts["train"] == result.counts["validation"] == 2 and result.manifest["stats"]["token_counter"] == "letters"
    assert {len(v) for v in writer.records.values()} == {2} and all("instruction" in r for v in writer.records.values() for r in v)
    for bad in ({"generator": "nothing"}, {"generator": "qa", "chunker": "nothing"}):
        with pytest.raises(errors.ConfigError):
            build.build_dataset(spark, rows, **bad)


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    table = tmp_path / "t.csv"
    table.write_text("name,price\nx,1\ny,2\nx,1\n")
    out = str(tmp_path / "o")
    told = ["build", str(table), "-o", out, "--user", "Price of {name}?", "--assistant", "{price} coins", "--system", "s", "--valid", "0.5", "--lineage", "--tokens", "approx", "--max-tokens", "500"]
    assert cli.main(told) == 0 and "kept 2" in capsys.readouterr().out
    manifest = sinks.read_manifest(spark, f"{out}/manifest.json")
    assert [s["step"] for s in manifest["curation"]] == ["normalize", "dedup", "token_budget"] and manifest["sources"][0]["chars"] == len(table.read_text())
    assert manifest["counts"]["train"] == manifest["counts"]["validation"] == 1
    assert {json.loads(x)["source"] for x in open(f"{out}/lineage.jsonl")} == {str(table)}
    assert cli.main([*told, "--no-dedup"]) == 0 and "kept 3" in capsys.readouterr().out
    assert cli.main(["validate", f"{out}/train.jsonl", "--budget", "5"]) == 0 and "over_budget" in capsys.readouterr().out
    assert cli.main(["validate", f"{out}/train.jsonl", "--tokens", "words"]) == 2
    assert cli.main(["build", str(table), "-o", out, "--user", "only one"]) == 2
    assert cli.main(["build", str(tmp_path / "*.none"), "-o", out, "-g", "qa"]) == 2
    monkeypatch.setattr(providers, "probe", lambda host: providers.Server(host, "0.1.0", ()))
    assert cli.main(["setup"]) == 0 and "too old" in capsys.readouterr().out
