"""Examples: rows with ``messages`` (role, content, name, weight), ``source`` and the order key ``seq``."""

from __future__ import annotations

import hashlib
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import text as T
from ..functions.counters import APPROX, Counter

MESSAGE = "struct<role:string,content:string,name:string,weight:int>"
ROLES = ("system", "user", "assistant")


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("int").alias("weight"))


def qa(question: Column, answer: Column, system: Column | None = None) -> Column:
    """[system] user assistant; an empty or null system prompt is left out."""
    turns = [message("user", question), message("assistant", answer)]
    if system is None:
        return F.array(*turns)
    return F.when(F.coalesce(system, F.lit("")) == "", F.array(*turns)).otherwise(F.array(message("system", system), *turns))


@F.pandas_udf(StringType())
def _printed(roles: pd.Series, contents: pd.Series) -> pd.Series:
    def of(who, told) -> str:
        body = "".join([f"{r}\x1f{T.one_spaced(c)}\x1e" for r, c in zip(who, told, strict=True) if c is not None])
        return hashlib.sha256(unicodedata.normalize("NFC", body).casefold().encode()).hexdigest()

    return pd.Series([None if who is None else of(who, told) for who, told in zip(roles, contents, strict=True)], dtype=object)


def fingerprint(messages: Column, roles: tuple[str, ...] = ROLES) -> Column:
    """SHA-256 over role and normal content of messages in ``roles``; names and weights do not count.

    Contents are collapsed, joined, composed (NFC) and folded in one call of Python a batch: classes of
    white space and letters that Unicode defines take a regular expression of the JVM some twenty times as long.
    """
    chosen = F.filter(messages, lambda m: m["role"].isin(*roles))
    return _printed(F.transform(chosen, lambda m: m["role"]), F.transform(chosen, lambda m: F.make_valid_utf8(m["content"])))


def text_length(messages: Column, role: str | None = None) -> Column:
    chosen = messages if role is None else F.filter(messages, lambda m: m["role"] == role)
    return F.aggregate(chosen, F.lit(0), lambda a, m: a + F.length(m["content"]))


def example_tokens(messages: Column, counter: Counter = APPROX) -> Column:
    """Three for the record and for each message, its role and content, and its name plus one."""
    strings = F.flatten(F.transform(messages, lambda m: F.array(m["role"], m["content"], m["name"])))
    named = F.size(F.filter(messages, lambda m: m["name"].isNotNull()))
    return F.lit(3) + F.size(messages) * 3 + named + counter.total(strings)


def assistant_tokens(messages: Column, counter: Counter = APPROX) -> Column:
    return counter.total(F.transform(F.filter(messages, lambda m: m["role"] == "assistant"), lambda m: m["content"]))


def system_of(messages: Column) -> Column:
    return F.when(F.element_at(messages, 1)["role"] == "system", F.element_at(messages, 1)["content"])


def turns(messages: Column) -> Column:
    return F.when(F.element_at(messages, 1)["role"] == "system", F.slice(messages, 2, F.size(messages) - 1)).otherwise(messages)


def issues(messages: Column) -> Column:
    """All issue tags of typed messages (columns role, content, name, weight), in order."""
    def of(m: Column) -> Column:
        return F.array_compact(F.array(
            F.when(m["role"].isNull() | m["content"].isNull(), "message_missing_key"),
            F.when(~F.coalesce(m["role"], F.lit("")).isin(*ROLES, "function", "tool"), "unrecognized_role"),
            F.when(m["role"].isin("function", "tool"), "unsupported_tool_calls"),
            F.when(T.is_blank(F.coalesce(m["content"], F.lit(""))), "missing_content"),
            F.when(m["weight"].isNotNull() & (~m["weight"].isin(0, 1) | (m["role"] != "assistant")), "invalid_weight"),
        ))

    def role(m: Column) -> Column:
        return F.coalesce(m["role"], F.lit(""))

    whole = F.array_compact(F.array(
        F.when(~F.exists(messages, lambda m: role(m) == "assistant"), "example_missing_assistant_message")
        .when(role(F.element_at(messages, -1)) != "assistant", "last_not_assistant"),
        F.when(F.exists(F.slice(messages, 2, F.size(messages)), lambda m: role(m) == "system"), "system_not_first"),
    ))
    empty = messages.isNull() | (F.size(messages) == 0)
    return F.when(empty, F.array(F.lit("missing_messages_list"))).otherwise(F.concat(F.flatten(F.transform(messages, of)), whole))
