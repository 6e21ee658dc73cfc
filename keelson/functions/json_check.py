"""Strict validation of JSON documents whose text stays as it is.

Most documents are settled in the JVM: one that Spark's strict parser accepts, and that is a single element of an array that holds nothing
else, is valid if it can't hold what that parser is too lenient about (long numbers, deep nesting, escapes of NUL and surrogates).
The others, among them those with repeated keys, which that parser rejects, are read in Arrow batches by Python's parser, which is told to keep numbers
as text and to refuse what isn't JSON.
"""

from __future__ import annotations

import json
import re
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGRAL, SCALE, DEPTH = 131_072, 16_383, 127  # most digits before and after the point, and nested levels
PLAIN = 4000  # characters; no number that short has too many digits
UNUSUAL = re.compile(r"[0-9][eE][+-]?[0-9]{4}|NaN|Infinity")
NUMBER = re.compile(r"-?(\d+)(?:\.(\d+))?(?:[eE]([+-]?\d+))?\Z")


# the function below travels with its module's code, so workers needn't have this library
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Refused(ValueError):
    pass


def _number(text: str) -> str:
    whole, part, power = NUMBER.match(text).groups()
    if power and len(power.lstrip("+-0")) > 9:
        if (whole + (part or "")).strip("0"):
            raise Refused("number")
        return text
    shift = int(power or 0)
    digits = whole.lstrip("0")
    lead = len(digits) if digits else -(len(part or "") - len((part or "").lstrip("0")))
    if lead + shift > INTEGRAL or len(part or "") - shift > SCALE:
        raise Refused("number")
    return text


def _constant(text: str) -> None:
    raise Refused(text)


def _nested(text: str) -> int:
    most = now = 0
    if text.count("[") + text.count("{") <= DEPTH:
        return 0
    for c in re.sub(r'"(?:[^"\\]|\\.)*"', "", text):
        if c in "[{":
            now += 1
            most = max(most, now)
        elif c in "]}":
            now -= 1
    return most


def _strings(value) -> None:
    if isinstance(value, str):
        if "\0" in value or any(0xD800 <= ord(c) <= 0xDFFF for c in value):
            raise Refused("string")
    elif isinstance(value, list):
        for x in value:
            _strings(x)
    elif isinstance(value, dict):
        for k, x in value.items():
            _strings(k)
            _strings(x)


def valid(text: str | None) -> bool | None:
    """Whether a text is exactly one JSON document without NUL or lone surrogates, its numbers in range."""
    if text is None:
        return None
    if _nested(text) > DEPTH:
        return False
    if len(text) < PLAIN and "\\u" not in text and "\0" not in text and not UNUSUAL.search(text):
        try:  # nothing in it needs a second look
            json.loads(text)
        except ValueError:
            return False
        return not text.startswith("\ufeff")

    def keep(pairs: list) -> dict:
        for k, v in pairs:  # repeated keys are allowed, and each value counts
            _strings(k)
            _strings(v)
        return dict(pairs)

    try:
        _strings(json.loads(text, parse_int=_number, parse_float=_number, parse_constant=_constant, object_pairs_hook=keep))
    except (ValueError, RecursionError):
        return False
    return not text.startswith("﻿")


@F.pandas_udf(T.BooleanType())
def _read(texts: pd.Series) -> pd.Series:
    return texts.map(valid, na_action="ignore").astype(object).where(texts.notna(), None)


def settled(text: Column) -> Column:
    """True for documents whose validity the JVM can tell; else false."""
    brackets = F.char_length(text) - F.char_length(F.translate(text, "[{", ""))
    plain = (F.char_length(text) < PLAIN) & ~F.contains(text, F.lit("\\u")) & ~F.contains(text, F.lit("\0")) & (brackets <= DEPTH) & ~text.rlike(r"[0-9][eE][+-]?[0-9]{4}")
    alone = (F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1) & (F.json_array_length(F.concat(F.lit("["), text, F.lit(",0]"))) == 2)
    return F.coalesce(plain & F.try_parse_json(text).isNotNull() & alone, F.lit(False))


def is_json(text: Column) -> Column:
    """Whether a text is one JSON document, as valid says; null for null."""
    known = settled(text)
    return F.when(known, F.lit(True)).otherwise(_read(F.when(~known, text)))
