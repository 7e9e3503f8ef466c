"""Model-backed generators: chunks to examples through a completion provider.

Each Python worker builds its provider once a partition. Rows carry either an example or an
error, so a build can skip chunks that failed; provider errors stop it.

A chunk's reply is known by what was asked (see ``reply_key``). Tasks write replies down as they come, in
a journal of their own in the folder ``replies``: a task that is run again, and a later run with the same
folder, asks only for what no journal holds.
"""

from __future__ import annotations

import hashlib
import io
import json
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import GenerationError, TruncatedOutputError
from ..functions import text as T
from ..functions.counters import APPROX, Counter
from ..prompts import Wording, wording
from ..sources import paths
from ..tables import cut, shared_dir
from . import curate, generate
from . import messages as M

_REPLY = "key string, pairs array<array<string>>, error string"

KINDS = {"llm-qa": ("pairs", "pairs", ("question", "", "answer")), "llm-instruction": ("items", "items", ("instruction", "input", "output"))}


def reply_schema(kind: str, n: int) -> dict:
    key, _, (ask, more, reply) = KINDS[kind]
    names = [x for x in (ask, more, reply) if x]
    item = {"type": "object", "properties": {x: {"type": "string"} for x in names}, "required": names, "additionalProperties": False}
    return {"type": "object", "properties": {key: {"type": "array", "items": item, "minItems": 1, "maxItems": max(n, 1)}}, "required": [key], "additionalProperties": False}


def json_in(text: str):
    """The JSON of a reply: whole, without a code fence, or its outermost object or array; else None."""
    body = re.sub(r"^\s*```\w*\s*|\s*```\s*$", "", text)
    tries = [body] + [body[body.find(a) : body.rfind(b) + 1] for a, b in ("{}", "[]") if a in body]
    for x in tries:
        try:
            return json.loads(x)
        except ValueError:
            continue
    return None


def prompt_fingerprint(kind: str, prompts: Wording) -> str:
    """SHA-256 of what the model is told, so that a manifest shows when the wording changed."""
    told = "\x1f".join((kind, prompts[KINDS[kind][1]], prompts["again"], json.dumps(reply_schema(kind, 1), sort_keys=True)))
    return hashlib.sha256(told.encode()).hexdigest()


def items_in(got, key: str) -> list[dict]:
    rows = got.get(key, got.get("data")) if isinstance(got, dict) else got
    return [x for x in rows if isinstance(x, dict)] if isinstance(rows, list) else []


def asked(provider, kind: str, text: str, prompts: Wording, n: int, retries: int, temperature: float) -> list[tuple[str, str]]:
    """Pairs from one chunk. A cut-off reply halves the number asked for; other bad ones are asked again."""
    key, task, (ask, more, reply) = KINDS[kind]
    while True:
        talk = [{"role": "user", "content": prompts.filled(task, n=n, text=text)}]
        for _ in range(retries + 1):
            got = provider.complete(talk, reply_schema(kind, n), temperature)
            rows = items_in(json_in(got.text), key)
            if rows:
                def field(row, name):
                    return str(row.get(name) or "").strip() if name else ""

                made = [("\n\n".join(x for x in (field(r, ask), field(r, more)) if x) if field(r, ask) else "", field(r, reply)) for r in rows]
                return [(q, a) for q, a in made if q and a]
            if got.finish_reason == "length":
                break
            talk = talk + [{"role": "assistant", "content": got.text}, {"role": "user", "content": prompts["again"]}]
        else:
            raise GenerationError("no usable JSON in the reply")
        if n <= 1:
            raise TruncatedOutputError("the reply was cut off")
        n //= 2


def reply_key(kind: str, prompts: Wording, *asked_with) -> Column:
    """SHA-256 of all that a chunk's reply depends on, the column ``text`` included."""
    told = json.dumps([prompt_fingerprint(kind, prompts), *map(str, asked_with)])
    return F.sha2(F.concat(F.lit(told), F.lit("\x1f"), F.col("text")), 256)


class Journal:
    """Replies of one task, by key, in files that only grow; of earlier attempts of the task the keys are read first,
    line by line, so that a worker holds no replies."""

    def __init__(self, folder: str, run: str):
        context = TaskContext.get()
        self.files, root = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        self.files.create_dir(root, recursive=True)
        stem = f"{root}/{run}-{context.partitionId()}-"
        self.known: set[str] = set()
        for info in self.files.get_file_info(fs.FileSelector(root)):
            if info.path.startswith(stem):
                with io.TextIOWrapper(self.files.open_input_stream(info.path), "utf-8", errors="replace", newline="\n") as file:
                    self.known.update(r["key"] for r in map(_whole_record, file) if r)
        self.out = self.files.open_output_stream(f"{stem}{context.attemptNumber()}-{uuid.uuid4().hex}.jsonl")

    def add(self, record: dict) -> None:
        self.out.write((json.dumps(record) + "\n").encode())
        self.out.flush()


def _whole_record(line: str) -> dict | None:
    """A journal's line; the last one of a task that was lost may be cut."""
    try:
        return json.loads(line)
    except ValueError:
        return None


def generate_with_model(
    chunks: DataFrame, provider: Callable[[], object], kind: str = "llm-qa", prompts: Wording = wording(), per_chunk: int = 3, max_input_tokens: int = 6000,
    max_retries: int = 1, min_grounding: float = 0.2, temperature: float = 0.2, system: str | None = None, counter: Counter = APPROX,
    replies: str | None = None, model_name: str = "",
) -> tuple[DataFrame, DataFrame]:
    """(examples, errors), after the model has been asked. Oversized chunks fail without a call;
    ungrounded answers go. ``replies`` is a folder of journals that workers reach through Arrow's file
    systems; a chunk that was asked before, of ``model_name`` and in the same words, is not asked again.
    Equal chunks are asked once."""
    spark = chunks.sparkSession
    replies = replies or f"{shared_dir(spark).rstrip('/')}/quillmill/replies-{uuid.uuid4().hex}"
    rows = chunks.where(~T.is_blank(F.col("text"))).select("seq", generate.place(F.lit(0)).alias("sub"), generate.ref().alias("source"), "text")
    rows = rows.withColumn("small", counter.count(F.col("text")) <= max_input_tokens)
    rows = cut(rows.withColumn("key", reply_key(kind, prompts, model_name, per_chunk, max_retries, temperature)), "asked")
    small, run_name = F.col("small"), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, journal = None, Journal(replies, run_name)
        for batch in batches:
            for key, text in ((k.as_py(), t.as_py()) for k, t in zip(batch.column("key"), batch.column("text"), strict=True)):  # one text at a time
                if key in journal.known:
                    continue
                model = model or provider()
                try:
                    journal.add({"key": key, "pairs": asked(model, kind, text, prompts, per_chunk, max_retries, temperature), "error": None})
                except GenerationError as e:
                    journal.add({"key": key, "pairs": [], "error": str(e)})
        journal.out.close()
        yield pa.RecordBatch.from_pydict({"done": [len(journal.known)]})

    def known() -> DataFrame:
        found = spark.read.schema(_REPLY).option("mode", "DROPMALFORMED").json(replies).where("key is not null")
        return found.groupBy("key").agg(F.min(F.struct("error", "pairs")).alias("r")).select("key", "r.*")

    wanted = rows.where(small).groupBy("key").agg(F.min("text").alias("text"))
    if paths.exists(spark, replies):
        wanted = wanted.join(known().where("error is null").select("key"), "key", "left_anti")  # what failed is asked again
    cut(cut(wanted, "wanted").mapInArrow(run, "done long"), "asked")
    got = known() if paths.exists(spark, replies) else spark.createDataFrame([], _REPLY)
    made = rows.where(small).drop("small").join(got, "key").select("seq", "sub", "source", "text", "error", F.posexplode_outer("pairs").alias("i", "pair"))
    made = made.select("seq", (F.col("sub") + F.coalesce("i", F.lit(0))).alias("sub"), "source", "text", F.col("pair")[0].alias("question"), F.col("pair")[1].alias("answer"), "error")
    made = cut(made.where("error is not null or question is not null"), "replies")
    fine = made.where("error is null").where(curate.grounded(F.col("answer"), F.col("text"), min_grounding))
    examples = fine.select("seq", "sub", "source", M.qa(F.col("question"), F.col("answer"), F.lit(system) if system else None).alias("messages"))
    large = rows.where(~small).select("source", F.lit(f"more than {max_input_tokens} tokens").alias("error"))
    return examples, made.where("error is not null").select("source", "error").union(large)


for _kind in KINDS:
    generate.register(_kind, lambda df, kind=_kind, **o: generate_with_model(df, kind=kind, **o))
