"""JSON in answers of language models: objects in running text, keys, fields with variants, cache keys."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtext.functions.json_repair import repaired


def object_text(col: str) -> Column:
    """From the first brace to the last; empty without one."""
    return F.regexp_extract(F.col(col), r"(\{[\s\S]*\})", 1)


def has_keys(col: Column, *keys: str) -> Column:
    """Whether the text is a JSON object with all the keys at its top level."""
    found = F.json_object_keys(col)
    test = F.lit(True)
    for k in keys:
        test = test & F.coalesce(F.array_contains(found, k), F.lit(False))
    return test


def keys_in_order(col: str, *keys: str) -> Column:
    """Whether the quoted keys occur, and in this order."""
    at = [F.instr(F.col(col), f'"{k}"') for k in keys]
    test = at[0] > 0
    for a, b in zip(at, at[1:], strict=False):
        test = test & (b > a)
    return test


def first_filled(*arrays: str) -> Column:
    """The first of several array columns that is not empty; variants of a misspelt field."""
    return F.coalesce(*[F.when(F.size(a) > 0, F.col(a)) for a in arrays])


def quoted(text: Column) -> Column:
    """A text as a JSON string, with no more escapes than JSON needs; null as the word null."""
    escaped = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for c in map(chr, range(32)):
        escaped = F.replace(escaped, F.lit(c), F.lit(json.dumps(c)[1:-1]))
    inside = F.when(text.rlike(r'[\x00-\x1f"\\]'), escaped).otherwise(text)
    return F.coalesce(F.concat(F.lit('"'), inside, F.lit('"')), F.lit("null"))


def request_json(messages: str, model: str, temperature: Column, top_p: Column) -> Column:
    """A request as JSON text: keys sorted, a blank after each comma and colon."""
    one = lambda m: F.concat(F.lit('{"content": '), quoted(m["content"]), F.lit(', "role": '), quoted(m["role"]), F.lit("}"))
    number = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    return F.concat(
        F.lit('{"messages": ['), F.array_join(F.transform(F.col(messages), one), ", "), F.lit('], "model": '), quoted(F.lit(model)),
        F.lit(', "temperature": '), number(temperature), F.lit(', "top_p": '), number(top_p), F.lit("}"),
    )


def cache_key(messages: str, model: str, temperature: Column, top_p: Column) -> Column:
    """SHA-512 of the request as JSON with sorted keys; messages: array of structs role, content."""
    return F.sha2(request_json(messages, model, temperature, top_p), 512)


@F.pandas_udf(T.StringType())
def repair_json(s: pd.Series) -> pd.Series:
    return s.map(repaired)
