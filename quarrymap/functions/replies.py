"""Repair of replies that were cut short."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

# Closing points, from the last, at which a cut object is tried; asides of models; fences around JSON.
TRIES = 50
ASIDE = r"(?s)<(think|thought)>.*?</\1>"
FENCE = r"(?m)^```(?:json)?\s*|\s*```$"
#: Strings, an open last one included, are stepped over; only brackets outside them count.
_PARTS = re.compile(r'"(?:[^"\\]|\\.)*(?:"|\\?$)|[\[\]{}]', re.DOTALL)
_ASIDE = re.compile(ASIDE)


def salvage(reply: str | None) -> dict | None:
    """The object of a cut reply, ended after its last whole nested value; None for whole replies and those without one."""
    reply = _ASIDE.sub("", reply or "")
    begin = reply.find("{")
    if begin < 0:
        return None
    expected, ends = "", []
    for part in _PARTS.finditer(reply, begin):
        if part[0] in ("{", "["):
            expected = ("}" if part[0] == "{" else "]") + expected
        elif part[0] in ("}", "]"):
            expected = expected[1:]
            if not expected:
                return None
            ends.append((part.end(), expected))
    for end, closing in ends[: -TRIES - 1 : -1]:
        try:
            return json.loads(reply[begin:end] + closing)
        except json.JSONDecodeError:
            pass
    return None


@pandas_udf(StringType())
def _salvaged(replies: pd.Series) -> pd.Series:
    found = (salvage(r) for r in replies)
    return pd.Series([None if f is None else json.dumps(f, ensure_ascii=False, separators=(",", ":")) for f in found], dtype=object)


def parsed(reply: Column) -> Column:
    """The JSON object of a reply, as JSON text: without asides and fences, or else what stands between the outermost braces; null otherwise."""
    bare = F.trim(F.regexp_replace(F.trim(F.regexp_replace(F.coalesce(reply, F.lit("")), ASIDE, "")), FENCE, ""))
    inner = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    whole = F.try_parse_json(bare)
    of = F.coalesce(whole, F.try_parse_json(F.when(inner != "", inner)))
    return F.when(F.schema_of_variant(of).startswith("OBJECT"), F.to_json(of))


def salvaged(reply: Column) -> Column:
    """``salvage`` as JSON text without spaces. Replies that are whole, or have no brace, are not given to it."""
    cut = F.coalesce(reply, F.lit("")).contains("{") & F.try_parse_json(F.regexp_replace(F.coalesce(reply, F.lit("")), ASIDE, "")).isNull()
    return _salvaged(F.when(cut, reply))
