"""Builds: read, chunk, generate, curate, split, encode and write, with lineage and a manifest."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import __version__
from .. import providers as P
from ..errors import ConfigError, GenerationError
from ..functions.counters import Counter, get_counter
from ..operators import chunk, curate, generate
from ..operators import formats as R
from ..operators import model as L
from ..operators.seen import FINGERPRINT, Seen
from ..prompts import wording
from ..sources import paths, readers, sinks
from ..tables import cut

#: Sources and errors that a manifest lists itself; beyond that all go to a folder beside it.
LISTED = 1000


@dataclass
class BuildResult:
    manifest: dict
    train: DataFrame
    validation: DataFrame
    report: list[dict]
    #: All sources (source, sha256, chars) and errors (source, error); None where a build has none.
    sources: DataFrame | None = None
    errors: DataFrame | None = None
    paths: dict[str, str] = field(default_factory=dict)

    @property
    def counts(self) -> dict[str, int]:
        return self.manifest["counts"]

    def __len__(self) -> int:
        return self.counts["train"] + self.counts["validation"]


@dataclass
class DatasetBuilder:
    """One generator over documents, then curation, split and files.

    ``generator`` is a name or a function of chunks that returns examples, or examples and
    (source, error) rows. ``chunker`` is a function of documents. ``on_error='skip'`` lists chunks
    whose generation failed; ``'raise'`` stops at the first. ``writer`` has ``format`` and
    ``write(examples, path)``.
    """

    generator: str | Callable[[DataFrame], DataFrame | tuple[DataFrame, DataFrame]]
    chunker: Callable[[DataFrame], DataFrame] = chunk.no_chunks
    steps: list[curate.Step] = field(default_factory=curate.default_steps)
    writer: object = field(default_factory=sinks.JsonlWriter)
    validation_fraction: float = 0.0
    seed: int = 42
    on_error: str = "skip"
    token_counter: str | Counter | None = None
    write_lineage: bool = False
    options: dict = field(default_factory=dict)
    described: dict = field(default_factory=dict)
    #: Folder of fingerprints that earlier builds have kept; this one drops them, and adds its own.
    seen: str | None = None

    def __post_init__(self) -> None:
        if self.on_error not in ("skip", "raise"):
            raise ValueError("on_error is 'skip' or 'raise'")
        self.counter = get_counter(self.token_counter)

    def create(self, documents: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """(examples, errors), unexecuted."""
        chunks = self.chunker(documents)
        made = generate.apply(self.generator, chunks, **self.options) if isinstance(self.generator, str) else self.generator(chunks)
        return made if isinstance(made, tuple) else (made, None)

    def examples(self, documents: DataFrame) -> tuple[DataFrame, list[dict]]:
        """Curated examples and the report, without files."""
        return curate.run(self.create(documents)[0], self.steps)

    def build(self, documents: DataFrame, out: str | None = None) -> BuildResult:
        made, errors = self.create(documents)
        return self.finish(made, errors, documents, out)

    def finish(self, examples: DataFrame, errors: DataFrame | None, sources: DataFrame | None, out: str | None) -> BuildResult:
        failed = 0
        if errors is not None:
            errors = cut(errors, "errors")
            failed = errors.count()
            if failed and self.on_error == "raise":
                first = errors.orderBy("source", "error").first()
                raise GenerationError(f"{first.source}: {first.error}")
        earlier = Seen(self.seen) if self.seen else None
        kept, report = curate.run(examples, earlier.ending(self.steps) if earlier else self.steps)
        parted = curate.split(kept.drop(FINGERPRINT), self.validation_fraction, self.seed)
        train, validation = (parted.where(F.col("split") == s).drop("split") for s in ("train", "validation"))
        counts = {r[0]: r[1] for r in parted.groupBy("split").count().collect()}
        read = None if sources is None else sources.select("source", "sha256", F.length("text").alias("chars"))
        manifest = {
            "quillmill_version": __version__, "created_at": datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ"),
            "generator": {}, "chunker": {}, **self.described,
            "sources": [] if read is None else [r.asDict() for r in read.limit(LISTED).collect()],
            "curation": report,
            "counts": {"generated": report[0]["in"] if report else 0, "kept": sum(counts.values()), "train": counts.get("train", 0), "validation": counts.get("validation", 0), "errors": failed},
            "errors": [r.asDict() for r in errors.orderBy("source", "error").limit(LISTED).collect()] if failed else [],
            "split": {"validation_fraction": self.validation_fraction, "seed": self.seed},
            "output": {"format": self.writer.format, "files": []},
            "stats": {"token_counter": self.counter.name, "tokens": curate.token_stats(parted, self.counter).first().asDict()},
        }
        result = BuildResult(manifest, train, validation, report, read, errors)
        if out:
            self._save(result, out)
        if earlier:
            earlier.remember(kept, FINGERPRINT)  # last, so that a build that fails has kept nothing
        return result

    def _save(self, result: BuildResult, out: str) -> None:
        """A folder for a path without suffix, else a file with its companions beside it."""
        spark = result.train.sparkSession
        base, suffix = os.path.splitext(out)
        names = {"train": out, "validation": f"{base}.validation{suffix}", "manifest": f"{out}.manifest.json", "lineage": f"{out}.lineage.jsonl"}
        if not suffix:
            names = {k: f"{out}/{k}.{'json' if k == 'manifest' else 'jsonl'}" for k in names}
        for name, rows in (("train", result.train), ("validation", result.validation)):
            if name == "validation" and not result.counts["validation"]:
                paths.remove(spark, names[name])  # a stale file of an earlier build
                continue
            entry = {"name": os.path.basename(names[name]), "records": self.writer.write(rows, names[name])}
            told = getattr(self.writer, "written", {}).get(names[name], {})
            if "sha256" in told or paths.is_file(spark, names[name]):
                entry["sha256"] = told.get("sha256") or paths.sha256(spark, names[name])
            if told.get("files"):
                entry["files"] = told["files"][:LISTED]
            result.manifest["output"]["files"].append(entry)
            result.paths[name] = names[name]
        if self.write_lineage:
            sinks.write_lineage(result.train, result.validation, names["lineage"])
            result.paths["lineage"] = names["lineage"]
        for name, rows in (("sources", result.sources), ("errors", result.errors)):
            if rows is not None and len(result.manifest[name]) == LISTED:  # there may be more
                result.paths[name] = f"{out}/{name}" if not suffix else f"{out}.{name}"
                rows.write.mode("overwrite").json(result.paths[name])
        result.paths["manifest"] = names["manifest"]
        sinks.write_manifest(spark, result.manifest, names["manifest"])


def _items(sources) -> list:
    return [sources] if isinstance(sources, (str, os.PathLike, DataFrame)) else list(sources)


def _generator_of(sources, generator: str) -> str:
    if generator != "auto":
        return generator
    items = _items(sources)
    if not items:
        raise ConfigError("no sources to read")
    return generate.for_source("" if isinstance(items[0], DataFrame) else str(items[0]))


def _template_rows(spark: SparkSession, sources, options: dict) -> DataFrame:
    made = None
    for i, item in enumerate(_items(sources)):
        table = item if isinstance(item, DataFrame) else readers.read_table(spark, str(item))
        label = {} if isinstance(item, DataFrame) else {"source": str(item)}
        rows = generate.template(table, **{**label, **options})
        rows = rows.withColumn("seq", F.col("seq") + F.lit(i * 2**52)) if i else rows
        made = rows if made is None else made.unionByName(rows)
    if made is None:
        raise ConfigError("no sources to read")
    return made


def _planned(generator, chunker, lang: str, chunk_options: dict | None, options: dict, provider=None, model: str | None = None):
    """(chunker's name, chunker, generator's options). Converters see whole documents; model-backed
    generators get paragraphs of 600 characters."""
    asks = isinstance(generator, str) and generate.needs_provider(generator)
    if asks and not callable(options.get("provider")):
        options = {**options, "provider": P.maker(options.get("provider", provider), model)}
    if isinstance(generator, str):
        if generator not in generate.available():
            raise ConfigError(f"unknown generator {generator!r}; known: {', '.join(generate.available())}")
        options = generate.localised(generator, lang, options.pop("prompts", None), options)
    if callable(chunker):
        return getattr(chunker, "__name__", "custom"), chunker, options
    name = chunker or ("paragraphs" if asks else "none")
    if name not in chunk.CHUNKERS:
        raise ConfigError(f"unknown chunker {name!r}; known: {', '.join(sorted(chunk.CHUNKERS))}")
    sizes = chunk_options if chunk_options is not None else ({"max_chars": 600} if asks and chunker is None else {})
    return name, lambda docs: chunk.CHUNKERS[name](docs, **sizes), options


def examples_of(spark: SparkSession, sources, generator: str = "auto", chunker: str | None = None, lang: str = "en", chunk_options: dict | None = None, **options) -> DataFrame:
    """Generated examples as an unexecuted frame. ``auto`` follows the first source's suffix."""
    name = _generator_of(sources, generator)
    if name == "template":
        return _template_rows(spark, sources, options)
    _, cutter, options = _planned(name, chunker, lang, chunk_options, dict(options))
    return DatasetBuilder(name, cutter, options=options).create(readers.read_documents(spark, sources))[0]


def build_examples(
    examples: DataFrame, out: str | None = None, fmt: str = "openai-chat", steps: list[curate.Step] | None = None, deduplicate: bool = True,
    max_tokens: int | None = None, validation_fraction: float = 0.0, seed: int = 42, described: dict | None = None,
    token_counter: str | Counter | None = None, write_lineage: bool = False, seen: str | None = None, single_file: bool = True,
) -> BuildResult:
    """Curate, split, encode and write a frame of examples. Explicit ``steps`` override the default ones.

    Without ``single_file`` train and validation are folders of parts, whose hashes the manifest lists.

    ``seen`` is a folder of fingerprints: what earlier builds with it have kept is dropped, and what this one keeps is added.
    """
    counter = get_counter(token_counter)
    steps = curate.default_steps(deduplicate, max_tokens, counter) if steps is None else steps
    described = described or {"generator": {"name": "prebuilt", "params": {}}, "chunker": {"name": "none"}}
    made = DatasetBuilder("prebuilt", steps=steps, writer=sinks.JsonlWriter(fmt, single_file), validation_fraction=validation_fraction, seed=seed, token_counter=counter, write_lineage=write_lineage, described=described, seen=seen)
    return made.finish(examples, None, None, out)


def build_dataset(
    spark: SparkSession, sources, out: str | None = None, generator="auto", chunker=None, lang: str = "en", fmt: str = "openai-chat", chunk_options: dict | None = None,
    steps: list[curate.Step] | None = None, deduplicate: bool = True, max_tokens: int | None = None, validation_fraction: float = 0.0, seed: int = 42,
    provider=None, model: str | None = None, system_prompt: str | None = None, token_counter: str | Counter | None = None, on_error: str = "skip",
    write_lineage: bool = False, seen: str | None = None, **options,
) -> BuildResult:
    """Read sources, generate, curate and write a dataset.

    ``seen`` is a folder of fingerprints: what earlier builds with it have kept is dropped, and what this one keeps is added.

    ``generator`` is a name, ``auto`` (by the first source's suffix, never a model) or a
    function of chunks; ``provider`` a name, an instance or a function that workers call.
    """
    counter = get_counter(token_counter)
    steps = curate.default_steps(deduplicate, max_tokens, counter) if steps is None else steps
    if system_prompt is not None:
        options.setdefault("system", system_prompt)
    name = _generator_of(sources, generator) if isinstance(generator, str) else getattr(generator, "__name__", "custom")
    params = {k: str(v) for k, v in options.items() if k not in ("provider", "prompts")}
    common = {"steps": steps, "writer": sinks.JsonlWriter(fmt), "validation_fraction": validation_fraction, "seed": seed, "on_error": on_error, "token_counter": counter, "write_lineage": write_lineage, "seen": seen}
    documents = readers.read_documents(spark, [s for s in _items(sources) if name != "template" or not isinstance(s, DataFrame)])
    if name == "template":
        described = {"generator": {"name": name, "params": params}, "chunker": {"name": "none"}}
        return DatasetBuilder(name, described=described, **common).finish(_template_rows(spark, sources, options), None, documents, out)
    title, cutter, options = _planned(name if isinstance(generator, str) else generator, chunker, lang, chunk_options, dict(options), provider, model)
    if generate.needs_provider(name):
        options.setdefault("counter", counter)
        options.setdefault("model_name", f"{provider if isinstance(provider, str) else type(provider).__name__} {model or ''}")
        params |= {"provider": provider if isinstance(provider, str) else type(provider).__name__, "model": model or "", "prompts": L.prompt_fingerprint(name, options.get("prompts") or wording(lang))}
    described = {"generator": {"name": name, "params": params}, "chunker": {"name": title}}
    made = DatasetBuilder(name if isinstance(generator, str) else generator, cutter, options=options, described=described, **common)
    return made.build(documents, out)


def convert_jsonl(spark: SparkSession, path: str, out: str, to: str = "openai-chat", input_format: str = "auto", on_invalid: str = "raise", **options) -> BuildResult:
    """Rewrite a JSONL dataset in another format, through the same curation and split."""
    described = {"generator": {"name": "prebuilt", "params": {"source": path}}, "chunker": {"name": "none"}}
    return build_examples(readers.read_examples(spark, path, input_format, on_invalid), out, to, described=described, **options)
