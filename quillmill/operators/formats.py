"""Record formats: openai-chat, alpaca and sharegpt, as Column expressions over JSON text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import FormatError
from ..functions import text as T
from . import messages as M

NAMES = ("openai-chat", "sharegpt", "alpaca")
# Speakers and keys of the public formats.
SPEAKERS = {"system": "system", "human": "user", "user": "user", "gpt": "assistant", "assistant": "assistant"}
CHAT_KEYS = ("role", "content", "name", "weight", "function_call", "tool_calls", "tool_call_id", "refusal")
TOOL_KEYS = ("function_call", "tool_calls", "tool_call_id")


def get_format(name: str) -> str:
    if name not in NAMES:
        raise FormatError(f"unknown format {name!r}; known: {', '.join(NAMES)}")
    return name


def _has(rec: Column, key: str) -> Column:
    return F.try_variant_get(rec, f"$.{key}", "variant").isNotNull()


def _string(rec: Column, path: str) -> Column:
    """The string at a path; null for other kinds."""
    kind = F.schema_of_variant(F.try_variant_get(rec, path, "variant"))
    return F.when(kind == "STRING", F.try_variant_get(rec, path, "string"))


def is_object(rec: Column) -> Column:
    return F.schema_of_variant(rec).startswith("OBJECT")


def detect(rec: Column) -> Column:
    """Format name of a parsed record by its keys; null where none fits."""
    return F.when(~is_object(rec), None).when(_has(rec, "messages"), "openai-chat").when(_has(rec, "conversations"), "sharegpt").when(
        _has(rec, "instruction") & _has(rec, "output"), "alpaca"
    )


def encode_openai(messages: Column) -> Column:
    return F.to_json(F.struct(messages.alias("messages")))


def alpaca_fits(messages: Column) -> Column:
    rest = M.turns(messages)
    return (F.size(rest) == 2) & (F.element_at(rest, 1)["role"] == "user")


def encode_alpaca(messages: Column) -> Column:
    """One exchange with an optional system prompt; other shapes raise an error."""
    rest = M.turns(messages)
    made = F.to_json(F.struct(
        F.element_at(rest, 1)["content"].alias("instruction"), F.lit("").alias("input"),
        F.element_at(rest, 2)["content"].alias("output"), M.system_of(messages).alias("system"),
    ))
    return F.when(alpaca_fits(messages), made).otherwise(F.raise_error(F.lit("alpaca holds one user/assistant exchange only")))


def encode_sharegpt(messages: Column) -> Column:
    speaker = {"system": "system", "user": "human", "assistant": "gpt"}
    told = F.transform(messages, lambda m: F.struct(F.create_map(*(F.lit(x) for p in speaker.items() for x in p))[m["role"]].alias("from"), m["content"].alias("value")))
    return F.to_json(F.struct(told.alias("conversations")))


ENCODERS = {"openai-chat": encode_openai, "alpaca": encode_alpaca, "sharegpt": encode_sharegpt}


def _elements(rec: Column, key: str) -> Column:
    """A list under a key as an array of variants; null for other kinds."""
    return F.try_variant_get(rec, f"$.{key}", "array<variant>")


def _keys(v: Column) -> Column:
    return F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))


def chat_issues(rec: Column) -> Column:
    """All issue tags of a raw openai-chat record; empty where it is fine."""
    turns = _elements(rec, "messages")

    def of(m: Column) -> Column:
        keys, role, content = _keys(m), _string(m, "$.role"), _string(m, "$.content")
        weight = F.try_variant_get(m, "$.weight", "variant")
        kind, number = F.schema_of_variant(weight), F.try_variant_get(m, "$.weight", "double")
        fine_weight = ~kind.isin("BOOLEAN", "STRING") & number.isin(0.0, 1.0) & (F.coalesce(role, F.lit("")) == "assistant")
        known = F.coalesce(role, F.lit("")).isin(*M.ROLES, "function", "tool")
        tools = role.isin("function", "tool") | F.arrays_overlap(keys, F.array(*map(F.lit, TOOL_KEYS)))
        found = F.array_compact(F.array(
            F.when(~(F.array_contains(keys, "role") & F.array_contains(keys, "content")), "message_missing_key"),
            F.when(F.exists(keys, lambda k: ~k.isin(*CHAT_KEYS)), "message_unrecognized_key"),
            F.when(~known, "unrecognized_role").when(tools, "unsupported_tool_calls"),
            F.when(T.is_blank(F.coalesce(content, F.lit(""))), "missing_content"),
            F.when(weight.isNotNull() & ~F.is_variant_null(weight) & ~F.coalesce(fine_weight, F.lit(False)), "invalid_weight"),
        ))
        return F.when(is_object(m), found).otherwise(F.array(F.lit("data_type")))

    def role_of(m: Column) -> Column:
        return F.when(is_object(m), F.coalesce(_string(m, "$.role"), F.lit(""))).otherwise("")

    objects = F.filter(turns, is_object)
    whole = F.array_compact(F.array(
        F.when(~F.exists(turns, lambda m: role_of(m) == "assistant"), "example_missing_assistant_message")
        .when(role_of(F.element_at(turns, -1)) != "assistant", "last_not_assistant"),
        F.when(F.exists(F.slice(objects, 2, F.greatest(F.size(objects), F.lit(1))), lambda m: role_of(m) == "system"), "system_not_first"),
    ))
    none = F.array().cast("array<string>")
    return (
        F.when(rec.isNull(), none).when(~is_object(rec), F.array(F.lit("data_type")))
        .when(turns.isNull() | (F.size(turns) == 0), F.array(F.lit("missing_messages_list")))
        .otherwise(F.concat(F.flatten(F.transform(turns, of)), whole))
    )


def _typed(m: Column, role: Column, content: Column, extras: bool) -> Column:
    name = F.try_variant_get(m, "$.name", "string") if extras else F.lit(None).cast("string")
    weight = F.try_variant_get(m, "$.weight", "int") if extras else F.lit(None).cast("int")
    return F.struct(role.alias("role"), content.alias("content"), name.alias("name"), weight.alias("weight"))


def decode_openai(rec: Column) -> Column:
    return F.transform(_elements(rec, "messages"), lambda m: _typed(m, _string(m, "$.role"), _string(m, "$.content"), True))


def decode_sharegpt(rec: Column) -> Column:
    roles = F.create_map(*(F.lit(x) for p in SPEAKERS.items() for x in p))
    return F.transform(_elements(rec, "conversations"), lambda m: _typed(m, roles[_string(m, "$.from")], _string(m, "$.value"), False))


def decode_alpaca(rec: Column) -> Column:
    more = _string(rec, "$.input")
    question = F.when(~T.is_blank(F.coalesce(more, F.lit(""))), F.concat(_string(rec, "$.instruction"), F.lit("\n\n"), more)).otherwise(_string(rec, "$.instruction"))
    system = F.when(~T.is_blank(F.coalesce(_string(rec, "$.system"), F.lit(""))), _string(rec, "$.system"))
    return M.qa(question, _string(rec, "$.output"), system)


def decode(rec: Column, fmt: Column) -> Column:
    return F.when(fmt == "openai-chat", decode_openai(rec)).when(fmt == "sharegpt", decode_sharegpt(rec)).when(fmt == "alpaca", decode_alpaca(rec))


def record_issues(rec: Column, fmt: Column) -> Column:
    """Tags under a format; null format gives unknown_format, unparsed JSON invalid_json.

    A chat record with a blank name is invalid_name; the other formats report their first fault.
    """
    chat = chat_issues(rec)
    blank_name = F.exists(decode_openai(rec), lambda m: m["name"].isNotNull() & T.is_blank(m["name"]))
    chat = F.when((F.size(chat) == 0) & blank_name, F.array(F.lit("invalid_name"))).otherwise(chat)
    told = decode_sharegpt(rec)
    first = F.filter(F.transform(told, lambda m: F.when(m["content"].isNull(), "missing_content").when(m["role"].isNull(), "unrecognized_role").when(T.is_blank(m["content"]), "missing_content")), lambda t: t.isNotNull())
    shape = M.issues(told)
    share = F.when(told.isNull() | (F.size(told) == 0), F.array(F.lit("missing_messages_list"))).when(F.size(first) > 0, F.slice(first, 1, 1)).otherwise(F.slice(shape, 1, 1))
    ask, reply = _string(rec, "$.instruction"), _string(rec, "$.output")
    alpaca = F.when(~(_has(rec, "instruction") & _has(rec, "output")), F.array(F.lit("missing_messages_list"))).when(
        T.is_blank(F.coalesce(ask, F.lit(""))) | T.is_blank(F.coalesce(reply, F.lit(""))), F.array(F.lit("missing_content"))
    ).otherwise(F.array().cast("array<string>"))
    return (
        F.when(rec.isNull(), F.array(F.lit("invalid_json"))).when(~is_object(rec), F.array(F.lit("data_type")))
        .when(fmt.isNull(), F.array(F.lit("unknown_format"))).when(fmt == "openai-chat", chat).when(fmt == "sharegpt", share).otherwise(alpaca)
    )
