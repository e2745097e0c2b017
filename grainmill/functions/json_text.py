"""JSON objects inside free text, where no built-in expression scans for them; Arrow batches, one text at a time inside."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType


def objects(text: str) -> list[dict]:
    """All outermost JSON objects of a text in order, found by trying every opening brace outside the last object."""
    decoder = json.JSONDecoder()
    out, at = [], text.find("{")
    while at >= 0:
        try:
            value, end = decoder.raw_decode(text, at)
        except ValueError:
            end = at + 1
        else:
            out.append(value)
        at = text.find("{", end)
    return out


@F.pandas_udf(StringType())
def json_first(text: pd.Series) -> pd.Series:
    """The first JSON object of a text, in compact form with sorted keys."""
    return text.map(lambda t: next((json.dumps(o, sort_keys=True, separators=(",", ":")) for o in objects(t)), None) if t else None)


@F.pandas_udf(StringType())
def json_last(text: pd.Series) -> pd.Series:
    """The last JSON object of a text, in compact form with sorted keys."""
    return text.map(lambda t: next((json.dumps(o, sort_keys=True, separators=(",", ":")) for o in reversed(objects(t))), None) if t else None)


def _numbers(value, strict: bool) -> bool:
    if isinstance(value, dict):
        return all(_numbers(v, strict) for v in value.values())
    if isinstance(value, list):
        return all(_numbers(v, strict) for v in value)
    return not isinstance(value, float) or (value == value and abs(value) != float("inf"))


@F.pandas_udf(BooleanType())
def is_strict_json(text: pd.Series) -> pd.Series:
    """Whether the whole text is one JSON value without NaN or infinities."""

    def test(t):
        try:
            return t is not None and _numbers(json.loads(t), True)
        except ValueError:
            return False

    return text.map(test).astype("boolean")
