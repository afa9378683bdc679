"""Keys of content: canonical JSON, digests, and the fingerprint of all that an answer depends on."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What changes no answer.
NEUTRAL = {"cache": None, "analyst": ["shortlist_max_tokens"]}
FORMAT = 3


def json_text(value: Column) -> Column:
    """A string as JSON writes it, without escapes of letters."""
    inner = F.to_json(F.array(F.coalesce(value, F.lit(""))))
    return F.substring(inner, F.lit(2), F.length(inner) - 2)


def canonical_record(fields: dict[str, Column]) -> Column:
    """An object of strings with sorted keys, as ``json.dumps(.., sort_keys=True, ensure_ascii=False)`` writes it."""
    parts = [F.concat(F.lit(json.dumps(k, ensure_ascii=False) + ": "), json_text(c)) for k, c in sorted(fields.items())]
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def canonical_digest(rows: DataFrame, order: str, fields: list[str], digits: int = 12) -> DataFrame:
    """One row: the digest of all records in order, as one JSON array. A dictionary is bounded; larger tables use sums of hashes."""
    told = rows.select(F.col(order).alias("_qm_o"), canonical_record({f: F.col(f).cast("string") for f in fields}).alias("r"))
    whole = F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_qm_o", "r"))), lambda x: x["r"]), ", "), F.lit("]"))
    return told.agg(F.substring(F.sha2(whole, 256), 1, digits).alias("digest"))


def fingerprint(settings: dict, model: dict, dictionary: str, groups: list[dict], top: int, stopwords: list[str], prompts: str) -> str:
    """What an answer depends on besides the question; any change makes earlier answers unusable. Groups in any order."""
    kept = {k: {f: v for f, v in s.items() if f not in (NEUTRAL.get(k) or [])} if isinstance(s, dict) else s for k, s in settings.items() if NEUTRAL.get(k, ()) is not None}
    terms = sorted([g["term"], *g["equivalents"], g["domain"], g["note"]] for g in groups)
    told = kept | {"llm": {k: model.get(k) for k in ("model", "temperature", "reasoning_effort", "seed")}}
    told["_"] = {"format": FORMAT, "dictionary": dictionary, "terms": terms, "stopwords": sorted(stopwords), "top": top, "prompts": prompts}
    return hashlib.sha256(json.dumps(told, ensure_ascii=False, sort_keys=True, default=str).encode()).hexdigest()[:16]
