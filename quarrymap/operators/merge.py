"""Reconciling a curated snapshot with its source: which value stays, what changed, what goes.

A curated value stays whatever the source says; only a value that came from the source follows it. A source text that rules
have cleaned stays clean while the source keeps the text it was cleaned from. Null counts as empty.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of origins.
SOURCE, PRIOR = "kaynak", "onceki"


def _filled(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def picked(prior: Column, origin: Column, source: Column, cleaned_from: Column | None = None) -> Column:
    """struct(value, origin) of a field."""
    prior, origin, source = _filled(prior), _filled(origin), _filled(source)
    cleaned = F.lit("") if cleaned_from is None else _filled(cleaned_from)
    pair = lambda value, told: F.struct(value.alias("value"), told.alias("origin"))
    follows = (origin == SOURCE) & (source != "") & (source != prior) & ~((cleaned != "") & (source == cleaned))
    fresh = pair(source, F.when(source != "", SOURCE).otherwise(""))
    kept = pair(prior, F.when(origin == "", PRIOR).otherwise(origin))
    return F.when(prior == "", fresh).when(follows, pair(source, F.lit(SOURCE))).otherwise(kept)


def merge(prior: DataFrame, source: DataFrame, key: list[str], fields: list[str], catalog: DataFrame | None = None) -> DataFrame:
    """One row for each key of either side: key, kind, and for each field ``f``: f, f_origin, f_old.

    ``prior`` may have f_origin and f_from (what the value was cleaned from) for a field. kind is added, removed, kept (gone
    from the source, but ``catalog``, rows of keys, still has it), changed or same. Keys are unique on either side.
    """
    names = set(prior.columns)
    held = lambda name: F.col(name) if name in names else F.lit("")
    left = prior.select(*key, F.struct(*(x for f in fields for x in (F.col(f).alias(f), held(f"{f}_origin").alias(f"{f}_origin"), held(f"{f}_from").alias(f"{f}_from")))).alias("_prior"))
    right = source.select(*key, F.struct(*fields).alias("_source"))
    both = left.join(right, key, "full_outer")
    if catalog is None:
        both = both.withColumn("_held", F.lit(False))
    else:
        known = catalog.select(*key).distinct().withColumn("_held", F.lit(True))
        both = both.join(known, key, "left").withColumn("_held", F.coalesce("_held", F.lit(False)))
    both = both.withColumns({f"_{f}": picked(F.col(f"_prior.{f}"), F.col(f"_prior.{f}_origin"), F.col(f"_source.{f}"), F.col(f"_prior.{f}_from")) for f in fields})
    differs = reduce(lambda a, b: a | b, (_filled(F.col(f"_prior.{f}")) != F.col(f"_{f}.value") for f in fields))
    gone = F.when(F.col("_held"), "kept").otherwise("removed")
    kind = F.when(F.col("_prior").isNull(), "added").when(F.col("_source").isNull(), gone).when(differs, "changed").otherwise("same")
    out = [c for f in fields for c in (F.col(f"_{f}.value").alias(f), F.col(f"_{f}.origin").alias(f"{f}_origin"), _filled(F.col(f"_prior.{f}")).alias(f"{f}_old"))]
    return both.select(*key, kind.alias("kind"), *out)


def field_changes(merged: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """(key, field, old, new, origin) for each field of changed keys whose value is another."""
    told = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"{f}_old").alias("old"), F.col(f).alias("new"), F.col(f"{f}_origin").alias("origin")) for f in fields))
    return merged.where("kind = 'changed'").select(*key, F.explode(F.filter(told, lambda x: x["old"] != x["new"])).alias("_x")).select(*key, "_x.*")


def digests(rows: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """(key, digest): what a key's rows say, whatever their order; sums, so that no key's rows are gathered."""
    told = F.struct(*(_filled(F.col(f)).alias(f) for f in fields))
    sums = (F.sum(F.xxhash64(told, F.lit(seed)).cast("decimal(20,0)")).cast("string") for seed in range(4))
    return rows.groupBy(*key).agg(F.sha2(F.concat_ws(":", F.count(F.lit(1)).cast("string"), *sums), 256).alias("digest"))
