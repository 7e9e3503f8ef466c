"""What a build takes in place of its own parts."""

from __future__ import annotations

from typing import Protocol, runtime_checkable

from pyspark.sql import Column, DataFrame

from .providers import Provider

__all__ = ["Chunker", "Curation", "Generator", "Provider", "TokenCounter", "Writer"]


class Chunker(Protocol):
    """Documents (seq, source, text, sha256, index) to documents with numbers in ``index``."""

    def __call__(self, docs: DataFrame) -> DataFrame: ...


class Generator(Protocol):
    """Chunks to examples (seq, sub, source, messages), or to examples and (source, error) rows."""

    def __call__(self, chunks: DataFrame) -> DataFrame | tuple[DataFrame, DataFrame]: ...


class Curation(Protocol):
    """Examples to examples: a filter or a change. A step is a pair of a name and one of these."""

    def __call__(self, examples: DataFrame) -> DataFrame: ...


@runtime_checkable
class TokenCounter(Protocol):
    name: str

    def count(self, text: Column) -> Column: ...

    def total(self, strings: Column) -> Column: ...


@runtime_checkable
class Writer(Protocol):
    format: str

    def write(self, examples: DataFrame, destination: str) -> int: ...
