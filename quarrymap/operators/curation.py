"""Curation of a dictionary: rules over its rows, checks, the score card, samples, and corrections of objects."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymap.functions import curation as C
from quarrymap.functions.descriptions import code_literals
from quarrymap.functions.text import key_fold, split_terms

# Origins, verdicts, limits, and the dates that a grain asks for.
ADMIN, SOURCE = "yonetici", "kaynak"
RIGHT, MINOR, WRONG = "dogru", "kucuk", "hatali"
APPROVE, REVIEW, REJECT = "onaylanabilir", "incelenmeli", "reddedilmeli"
APPROVE_AT, REVIEW_AT, PENALTY, EXAMPLES = 90, 75, 10, 5
GRAIN_DATES = [
    (r"(?iu)karşılık tarihi", ["ProvisionDate"]),
    (r"(?iuU)veri tarihi|\bgün|günlük|kesit|× tarih\b", ["DataDate", "RecordDate", "ReportDate", "TranDate"]),
    (r"(?iu)rapor tarihi", ["ReportDate", "DataDate"]),
    (r"(?iuU)periyot|dönem|\bay\b|\(ay\)|aylık|ay sonu|çeyrek", ["Period", "PeriodId", "DataDate", "ReportDate"]),
    (r"(?iu)yıl", ["Year", "Period", "DataDate"]),
]
CHECKS = ["belirsizlik", "bos_aciklama", "aciklama_es_anlamli", "olmayan_anahtar_kolon", "olmayan_zaman_kolonu", "haric_kolon"]


def present_columns(listed: Column, columns: Column) -> Column:
    """The listed names that the object's columns have, in their spelling, each once."""
    own = lambda name: F.try_element_at(F.filter(columns, lambda c: key_fold(c) == key_fold(name)), F.lit(-1))
    return F.array_distinct(F.filter(F.transform(split_terms(F.coalesce(listed, F.lit(""))), own), lambda c: c.isNotNull()))


def date_key(grain: Column, keys: Column, times: Column) -> Column:
    """The keys, with the date that the grain is cut by unless one of the time columns is among them."""
    held = F.exists(keys, lambda k: F.exists(times, lambda t: key_fold(t) == key_fold(k)))
    found = lambda names: F.get(F.filter(F.array(*(F.try_element_at(F.filter(times, _named(n)), F.lit(-1)) for n in names)), lambda x: x.isNotNull()), F.lit(0))
    date = F.coalesce(*(F.when(F.coalesce(grain, F.lit("")).rlike(pattern), found(names)) for pattern, names in GRAIN_DATES))
    return F.when(held | date.isNull(), keys).otherwise(F.concat(keys, F.array(date)))


def _named(name: str):
    return lambda t: key_fold(t) == name.lower()


def align_objects(objects: DataFrame, columns: DataFrame, domains: dict[str, str]) -> DataFrame:
    """``objects`` (object_key, KeyColumns, TimeColumns, Grain, BusinessDomain) with fields that agree with ``columns`` (object_key, column_name)."""
    held = columns.groupBy("object_key").agg(F.collect_list("column_name").alias("_qm_columns"))
    rows = objects.join(held, "object_key", "left").withColumn("_qm_columns", F.coalesce("_qm_columns", F.array().cast("array<string>")))
    times = present_columns(F.col("TimeColumns"), F.col("_qm_columns"))
    keys = date_key(F.col("Grain"), present_columns(F.col("KeyColumns"), F.col("_qm_columns")), times)
    bare = F.trim(F.coalesce("BusinessDomain", F.lit("")))
    domain = reduce(lambda other, kv: F.when(bare == kv[0], kv[1]).otherwise(other), domains.items(), bare)
    return rows.withColumns({"KeyColumns": F.array_join(keys, ", "), "TimeColumns": F.array_join(times, ", "), "BusinessDomain": domain}).drop("_qm_columns")


def object_code(definitions: DataFrame, objects: DataFrame) -> DataFrame:
    """(object_key, bodies): the definitions (key, body) named after each object, and of its loader ins_..."""
    name = lambda c: key_fold(F.element_at(F.split(c, r"\."), F.lit(-1)))
    by_name = definitions.select(name(F.col("key")).alias("name"), "key", "body")
    own = objects.select("object_key", name(F.col("object_key")).alias("name"))
    wanted = own.unionByName(own.select("object_key", F.concat(F.lit("ins_"), F.regexp_replace("name", "^v", "")).alias("name")))
    return wanted.join(by_name, "name").groupBy("object_key").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("name").startswith("ins_").alias("loads"), "key", "body"))), lambda x: x["body"]).alias("bodies"))


def normalized(columns: DataFrame, support: DataFrame | None = None) -> DataFrame:
    """``columns`` (object_key, column_name, description, synonyms, summary, each with an ``.._origin``) by the rules.

    ``support`` (object_key, column_name, text) is what evidence and code say. An admin's text is left alone. The result has
    the new texts, ``removed``, and ``description_from``: the source's text that a cleaned one came from.
    """
    rows = columns
    if support is not None:
        rows = rows.join(support.withColumnRenamed("text", "_qm_support"), ["object_key", "column_name"], "left")
    held = F.concat_ws(" ", F.col("_qm_support") if support is not None else F.lit(""), "description")
    mine = lambda field: F.coalesce(F.col(f"{field}_origin") == ADMIN, F.lit(False))
    rows = rows.withColumn("_qm_d", C.cleaned_description(F.col("description"), held))
    better = lambda field, made: F.when(mine(field) | (made == ""), F.coalesce(F.col(field), F.lit(""))).otherwise(made)
    rows = rows.withColumn("_qm_new", better("description", F.col("_qm_d.text")))
    made = rows.withColumns(
        {
            "_qm_synonyms": better("synonyms", C.cleaned_synonyms(F.col("synonyms"), F.col("_qm_new"))),
            "_qm_summary": better("summary", C.cleaned_summary(F.col("summary"), held)),
            "removed": F.when(mine("description"), F.array().cast("array<string>")).otherwise(F.slice(F.array_distinct("_qm_d.removed"), 1, 20)),
            "description_from": F.when((F.col("description_origin") == SOURCE) & (F.col("_qm_new") != F.coalesce("description", F.lit(""))), F.col("description")),
        }
    )
    new = {"description": "_qm_new", "synonyms": "_qm_synonyms", "summary": "_qm_summary"}
    return made.select(*(F.col(new.get(c, c)).alias(c) for c in columns.columns), "removed", "description_from")


def normalized_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(object_key, column_name, field, old, new) for each field that the rules changed."""
    key, fields = ["object_key", "column_name"], ["description", "synonyms", "summary"]
    both = before.select(*key, *(F.coalesce(f, F.lit("")).alias(f"{f}_old") for f in fields)).join(after.select(*key, *fields), key)
    told = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"{f}_old").alias("old"), F.col(f).alias("new")) for f in fields))
    return both.select(*key, F.explode(F.filter(told, lambda x: x["old"] != x["new"])).alias("x")).select(*key, "x.*")


def mechanical_checks(objects: DataFrame, columns: DataFrame, ignored: list[str] | None = None) -> DataFrame:
    """(check, count, examples): what the rules find wrong, at most five examples each, in order of the dictionary.

    ``objects``: pos, object_key, ObjectDescription, KeyColumns, TimeColumns. ``columns``: pos, object_key, column_name,
    description, synonyms, summary.
    """
    held = columns.groupBy("object_key").agg(F.collect_list("column_name").alias("names"))
    tables = objects.join(held, "object_key", "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>")))
    odd = lambda field: F.size(present_columns(F.col(field), F.col("names"))) != F.size(F.array_distinct(F.transform(split_terms(F.coalesce(field, F.lit(""))), key_fold)))
    bare = lambda c: F.substring(F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"\.+$", ""), 1, 40)
    text = F.coalesce("description", F.lit(""))
    found_tables = {"belirsizlik": C.is_doubtful(F.col("ObjectDescription")), "olmayan_anahtar_kolon": odd("KeyColumns"), "olmayan_zaman_kolonu": odd("TimeColumns")}
    found_columns = {
        "belirsizlik": C.is_doubtful(F.col("description")) | C.is_doubtful(F.col("summary")) | C.is_doubtful(F.col("synonyms")),
        "bos_aciklama": F.trim(text) == "",
        "aciklama_es_anlamli": (text != "") & (bare("synonyms") == bare("description")),
        "haric_kolon": key_fold(F.col("column_name")).isin(ignored or [""]) & F.lit(bool(ignored)),
    }
    hits = lambda rows, tests, label: rows.select(label.alias("label"), "place", F.explode(F.filter(F.array(*(F.when(t, F.lit(n)) for n, t in tests.items())), lambda x: x.isNotNull())).alias("check"))
    of_tables = hits(tables.withColumn("place", F.struct(F.col("pos").alias("a"), F.lit(-1).cast("long").alias("b"))), found_tables, F.col("object_key"))
    placed = columns.join(objects.select("object_key", F.col("pos").alias("at")), "object_key").withColumn("place", F.struct(F.col("at").alias("a"), F.col("pos").cast("long").alias("b")))
    every = of_tables.unionByName(hits(placed, found_columns, F.concat_ws(".", "object_key", "column_name")))
    counts = every.groupBy("check").agg(F.count(F.lit(1)).alias("count"))
    first = every.withColumn("r", F.row_number().over(Window.partitionBy("check").orderBy("place"))).where(F.col("r") <= EXAMPLES)  # cut within tasks first
    examples = first.groupBy("check").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "label"))), lambda x: x["label"]).alias("examples"))
    names = columns.sparkSession.createDataFrame([(c,) for c in CHECKS], "check string")
    return names.join(counts, "check", "left").join(examples, "check", "left").select("check", F.coalesce("count", F.lit(0)).alias("count"), F.coalesce("examples", F.array().cast("array<string>")).alias("examples"))


def wilson(hits: Column, total: Column, z: float = 1.96) -> Column:
    """struct<low, high>: the interval of a share, within 0 and 1; 0 and 0 of nothing."""
    n = F.when(total > 0, total.cast("double"))
    p = hits / n
    centre, half = (p + z * z / (2 * n)) / (1 + z * z / n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    some = lambda c: F.when(total > 0, c).otherwise(0.0)
    return F.struct(some(F.greatest(F.lit(0.0), centre - half)).alias("low"), some(F.least(F.lit(1.0), centre + half)).alias("high"))


def verdict(score: Column, failed: Column, sample: Column, scope: Column) -> Column:
    good = (score >= APPROVE_AT) & ((sample > 0) | (scope == 0))
    return F.when(score < REVIEW_AT, REJECT).when(failed > 0, REVIEW).when(good, APPROVE).otherwise(REVIEW)


def score_card(failed: Column, right: Column, minor: Column, wrong: Column, calls: Column, failures: Column, scope: Column) -> dict[str, Column]:
    """score, verdict, wrong_low and wrong_high of an update, from the failed checks, the judge's verdicts and the model's calls."""
    sample = right + minor + wrong
    usable = F.when(sample > 0, 1 - wrong / F.when(sample > 0, sample)).otherwise(1.0)
    rate = F.when(calls > 0, failures / F.when(calls > 0, calls)).otherwise(0.0)
    score = F.bround(F.greatest(F.lit(0.0), 100 * usable * (1 - rate) - PENALTY * failed), 0).cast("int")
    interval = wilson(wrong, sample)
    return {"score": score, "verdict": verdict(score, failed, sample, scope), "wrong_low": F.bround(interval["low"], 3), "wrong_high": F.bround(interval["high"], 3)}


def rescored(score: Column, failed_before: Column, failed: Column, sample: Column, scope: Column) -> dict[str, Column]:
    """score and verdict after an edit: the penalties of before are given back, those of now taken."""
    now = F.greatest(F.lit(0), score + PENALTY * failed_before - PENALTY * failed)
    return {"score": now, "verdict": verdict(now, failed, sample, scope)}


def sample_rows(rows: DataFrame, key: list[str], size: int, seed: int) -> DataFrame:
    """At most ``size`` rows, the same for one seed whatever their order."""
    return rows.orderBy(F.xxhash64(*key, F.lit(seed)), *key).limit(size)


def judged(verdicts: DataFrame, by: list[str]) -> DataFrame:
    """The judge's verdicts by group: counts, shares and failures; other verdicts are failures."""
    n = lambda v: F.count(F.when(F.col("verdict") == v, 1))
    known = F.count(F.when(F.col("verdict").isin(RIGHT, MINOR, WRONG), 1))
    share = lambda v: F.round(F.try_divide(n(v), known), 6)
    return verdicts.groupBy(*by).agg(n(RIGHT).alias("n_right"), n(MINOR).alias("n_minor"), n(WRONG).alias("n_wrong"), (F.count(F.lit(1)) - known).alias("failures"), F.coalesce(share(WRONG), F.lit(0.0)).alias("wrong_share"))


def literals_of(code: DataFrame) -> DataFrame:
    """(object_key, text): the quoted values of an object's bodies, for support."""
    return code.select("object_key", F.array_join(F.flatten(F.transform("bodies", code_literals)), " ").alias("text"))
