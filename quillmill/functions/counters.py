"""Token counters: Arrow functions over whole batches."""

from __future__ import annotations

import importlib.util
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from ..errors import ConfigError
from . import text as T


@dataclass(frozen=True)
class Counter:
    """``sizes`` maps an array of strings to the array of their token counts (null: 0).

    Arrays are the unit because Python functions cannot run inside array functions: an
    example's roles, contents and names are counted in one call.
    """

    name: str
    sizes: Callable[[Column], Column]

    def count(self, text: Column) -> Column:
        return F.get(self.sizes(F.array(text)), 0)

    def total(self, strings: Column) -> Column:
        return F.aggregate(self.sizes(strings), F.lit(0), lambda a, x: a + x)


#: Characters that are looked up at a time.
SLICE = 1 << 20


@cache
def _kinds() -> np.ndarray:
    """For each code point: 0 white space, 1 part of a word, 2 a token of its own."""
    def kind(c: str) -> int:
        return 1 if c == "_" or unicodedata.category(c)[0] in "LN" else 0 if c.isspace() else 2

    return np.fromiter((kind(chr(i)) for i in range(0x110000)), dtype=np.uint8, count=0x110000)


def _pieces(text: str) -> int:
    """How many times ``text.TOKEN`` occurs: beginnings of words, and signs."""
    kinds, found, in_word = _kinds(), 0, False
    for lo in range(0, len(text), SLICE):
        part = text[lo : lo + SLICE]
        code = np.frombuffer(part.encode("latin-1"), np.uint8) if part.isascii() else np.frombuffer(part.encode("utf-32-le"), np.uint32)
        kind = kinds[code]
        word = kind == 1
        found += int(np.count_nonzero(word[1:] & ~word[:-1])) + int(word[0] and not in_word) + int(np.count_nonzero(kind == 2))
        in_word = bool(word[-1])
    return found


@F.pandas_udf(ArrayType(IntegerType()))
def _tokens(rows: pd.Series) -> pd.Series:
    return rows.map(lambda row: [0 if x is None else _pieces(x) for x in row], na_action="ignore")


def _approx(strings: Column) -> Column:
    """``text.approx_tokens`` of each string; pieces are counted in one call of Python a batch."""
    whole = F.transform(strings, lambda x: F.make_valid_utf8(x))
    return F.zip_with(strings, _tokens(whole), lambda x, n: F.coalesce(T.approx_of(x, n), F.lit(0)))


APPROX = Counter("approx", _approx)

_LOADED: dict[str, Callable[[str], int]] = {}  # one tokenizer a worker


def _arrow(name: str, load: Callable[[], Callable[[str], int]]) -> Counter:
    @F.pandas_udf("array<int>")
    def sizes(rows: pd.Series) -> pd.Series:
        if name not in _LOADED:
            _LOADED[name] = load()
        count = _LOADED[name]
        return rows.map(lambda row: [count(x) if x else 0 for x in row], na_action="ignore")

    return Counter(name, sizes)


def _tiktoken(encoding: str) -> Counter:
    if importlib.util.find_spec("tiktoken") is None:
        raise ConfigError("the tiktoken counter needs the tiktoken package")

    def load():
        import tiktoken

        found = tiktoken.get_encoding(encoding)
        return lambda text: len(found.encode(text, disallowed_special=()))

    return _arrow(f"tiktoken:{encoding}", load)


def _tokenizer(path: str) -> Counter:
    if importlib.util.find_spec("tokenizers") is None:
        raise ConfigError("the tokenizer counter needs the tokenizers package")

    def load():
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(path)
        return lambda text: len(found.encode(text, add_special_tokens=False).ids)

    return _arrow(f"tokenizer:{path}", load)


def get_counter(spec: str | Counter | None = None) -> Counter:
    """``approx`` (also None), ``tiktoken``, ``tiktoken:<encoding>``, ``tokenizer:<file>`` or a Counter.

    Encodings and tokenizer files are opened by the workers, so each must be able to reach them.
    """
    if isinstance(spec, Counter):
        return spec
    if spec is not None and not isinstance(spec, str):
        raise ConfigError(f"not a token counter: {spec!r}")
    kind, _, rest = (spec or "").strip().partition(":")
    if kind.lower() in ("", "approx", "approximate") and not rest:
        return APPROX
    if kind.lower() == "tiktoken":
        return _tiktoken(rest.lower() or "cl100k_base")
    if kind.lower() == "tokenizer" and rest:
        return _tokenizer(rest)
    raise ConfigError(f"unknown token counter {spec!r}; use approx, tiktoken, tiktoken:<encoding> or tokenizer:<file>")
