"""Documents, messages and examples as Python values, for small inputs and for reading results.

Frames are what the library works on; these are the rows' shapes with names, and ways to and from frames.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from enum import StrEnum

from pyspark.sql import DataFrame, Row, SparkSession

from .operators import messages as M


class Role(StrEnum):
    SYSTEM = "system"
    USER = "user"
    ASSISTANT = "assistant"


@dataclass(frozen=True)
class Message:
    role: Role
    content: str
    name: str | None = None
    weight: int | None = None

    def __post_init__(self) -> None:
        object.__setattr__(self, "role", Role(self.role))


@dataclass(frozen=True)
class Example:
    messages: tuple[Message, ...]
    source: str | None = None
    #: The order key: place among all examples, and within what they were made from.
    seq: int | None = None
    sub: int = 0

    @classmethod
    def of(cls, row: Row) -> Example:
        told = row.asDict()
        made = tuple(Message(m["role"], m["content"], m["name"], m["weight"]) for m in told["messages"])
        return cls(made, told.get("source"), told.get("seq"), told.get("sub") or 0)


@dataclass(frozen=True)
class Document:
    text: str
    source: str = "<string>"
    sha256: str = ""
    index: int = 0
    seq: int | None = field(default=None, compare=False)


def documents_frame(spark: SparkSession, documents: Iterable[Document]) -> DataFrame:
    """(seq, source, text, sha256, index) in the order given, where a document has no ``seq`` of its own."""
    rows = [(i if d.seq is None else d.seq, d.source, d.text, d.sha256, d.index) for i, d in enumerate(documents)]
    return spark.createDataFrame(rows, "seq long, source string, text string, sha256 string, index int")


def examples_frame(spark: SparkSession, examples: Iterable[Example]) -> DataFrame:
    """(seq, sub, source, messages) in the order given, where an example has no ``seq`` of its own."""
    rows = [(i if e.seq is None else e.seq, e.sub, e.source, [(m.role.value, m.content, m.name, m.weight) for m in e.messages]) for i, e in enumerate(examples)]
    return spark.createDataFrame(rows, f"seq long, sub long, source string, messages array<{M.MESSAGE}>")
