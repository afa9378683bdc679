"""Dictionaries, term lists and word lists as they are uploaded: their checks, warnings and records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrymap.functions.text import cell, column_letter, fold, split_synonyms
from quarrymap.operators.records import dense_ids
from quarrymap.session import checkpointed

# Sheets, fields and headers of the template, and limits of lists.
COLUMNS_SHEET, OBJECTS_SHEET = "Kolonlar", "Objeler"
COLUMN_FIELDS = ["DatabaseName", "SchemaName", "ObjectName", "ColumnName", "ColumnDescription", "Synonyms", "Role", "Summary"]
OBJECT_FIELDS = ["ObjectKey", "DatabaseName", "SchemaName", "ObjectName", "ObjectDescription", "Grain", "KeyColumns", "TimeColumns", "BusinessDomain", "DatasetGroup"]
REQUIRED = COLUMN_FIELDS[:5]
NAMES = ["DatabaseName", "SchemaName", "ObjectName"]
MAX_TERMS, MAX_TERM_CHARS = 200, 500
HEADER_WORDS = [
    "terim", "terimler", "talep", "talepler", "soru", "sorular", "arama", "kavram", "kavramlar", "term", "terms", "query", "queries", "request", "requests", "liste", "aranacak", "aranacaklar", "ihtiyac", "konu",
]
TERM_HEADERS = {"term": ["terim", "term"], "equivalents": ["esdegerler", "esdeger", "equivalents"], "domain": ["alan", "domain"], "note": ["not", "note", "aciklama"]}
STOPWORD_HEADERS = {"word": ["kelime", "word", "durakkelime"], "group": ["grup", "group"]}
MAX_ITEMS, MAX_TERM, MAX_EQUIVALENTS, MAX_DOMAIN, MAX_NOTE, MAX_WORD, MAX_GROUP = 5000, 200, 100, 100, 1000, 100, 200


def header_names(headers: list[str], aliases: dict[str, list[str]]) -> dict[str, str]:
    """Field -> the header that stands for it, without regard to case, accents and spaces."""
    import re

    from quarrymap.functions.text import folded

    held = {re.sub(" ", "", folded(h)): h for h in headers if h}
    return {field: held[a] for field, names in aliases.items() for a in names[:1] + [n for n in names[1:] if names[0] not in held] if a in held}


def template_warnings(headers: dict[str, list[str]]) -> list[str]:
    """A warning for each field of the template that its sheet has no column for; an object's key and its three names stand for each other."""
    out = []
    if OBJECTS_SHEET in headers:
        missing = [f for f in OBJECT_FIELDS if f not in headers[OBJECTS_SHEET]]
        keyed, named = "ObjectKey" not in missing, not set(NAMES) & set(missing)
        out += [f"{OBJECTS_SHEET}: {f}" for f in missing if not (f == "ObjectKey" and named or f in NAMES and keyed)]
    held = {h.casefold().replace(" ", "") for h in headers.get(COLUMNS_SHEET, [])}
    return out + [f"{COLUMNS_SHEET}: {f}" for f in COLUMN_FIELDS if f.casefold() not in held]


def build_columns(rows: DataFrame, groups: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(columns, warnings) of a dictionary's rows (pos from 0, and the template's fields).

    Rows without one of the four names are left out, and so are all but the first of a key; each gives a warning. Columns get
    dense ids in order, their synonyms as an array and the group of their object (object_key, group).
    """
    texts = rows.select("pos", *((cell(F.col(f)) if f in rows.columns else F.lit("")).alias(f) for f in COLUMN_FIELDS))
    whole = (F.col("DatabaseName") != "") & (F.col("SchemaName") != "") & (F.col("ObjectName") != "") & (F.col("ColumnName") != "")
    texts = checkpointed(texts.withColumns({"whole": whole, "key": F.concat_ws(".", *COLUMN_FIELDS[:4])}))
    firsts = texts.where("whole").groupBy("key").agg(F.min("pos").alias("first"))
    marked = texts.where("whole").join(firsts, "key")
    lost = texts.where("not whole").select("pos", F.concat(F.lit("Satır "), (F.col("pos") + 2).cast("string"), F.lit(": eksik veritabanı/şema/obje/kolon, atlandı")).alias("warning"))
    again = marked.where("pos > first").select("pos", F.concat(F.lit("Tekrarlanan kolon, ilk kayıt tutuldu: "), "key").alias("warning"))
    kept = dense_ids(marked.where("pos = first").drop("whole", "first"), "pos", "id")
    kept = kept.withColumns({"object_key": F.concat_ws(".", *NAMES), "synonym_list": split_synonyms(F.col("Synonyms"))})
    if groups is not None:
        kept = kept.join(groups.select("object_key", F.col("group").alias("dataset_group")), "object_key", "left")
    return kept, lost.unionByName(again)


def object_profiles(rows: DataFrame) -> DataFrame:
    """The last row of each object (pos, and the template's fields), by its key or its three names."""
    texts = rows.select("pos", *((cell(F.col(f)) if f in rows.columns else F.lit("")).alias(f) for f in OBJECT_FIELDS))
    keyed = texts.withColumn("object_key", F.when(F.col("ObjectKey") != "", F.col("ObjectKey")).otherwise(F.concat_ws(".", *NAMES))).where(F.regexp_replace("object_key", r"^\.+|\.+$", "") != "")
    last = keyed.groupBy("object_key").agg(F.max_by(F.struct(*OBJECT_FIELDS), "pos").alias("r"))
    listed = F.filter(F.transform(F.split("r.TimeColumns", ","), lambda t: F.trim(t)), lambda n: n != "")
    return last.select("object_key", F.col("r.ObjectDescription").alias("description"), F.col("r.Grain").alias("grain"), listed.alias("time_columns"), F.col("r.BusinessDomain").alias("domain"), F.col("r.DatasetGroup").alias("group"))


def term_list(cells: DataFrame) -> DataFrame:
    """One row for each upload (upload, row from 1, cells): terms in order, notes, and why it is refused; of its first sheet.

    Terms stand in column A below a header. Refused are uploads without terms or with other columns, terms that are too long
    and lists of too many; blank rows and repeats are noted.
    """
    filled = cells.select("upload", "row", F.posexplode("cells").alias("at", "value")).withColumn("value", F.trim(F.regexp_replace(cell(F.col("value")), r"(?U)\s+", " "))).where("value <> ''")
    shape = filled.groupBy("upload").agg(F.array_sort(F.collect_set("at")).alias("columns"), F.max("row").alias("last"), F.max(F.when((F.col("row") == 1) & (F.col("at") == 0), F.col("value"))).alias("header"))
    terms = filled.where("at = 0 and row > 1").withColumns({"key": fold(F.col("value")), "long": F.length("value") > MAX_TERM_CHARS})
    firsts = terms.groupBy("upload", "key").agg(F.min(F.struct("row", "value")).alias("f"), F.count(F.lit(1)).alias("n"))
    told = firsts.groupBy("upload").agg(F.transform(F.array_sort(F.collect_list("f")), lambda x: x["value"]).alias("terms"), F.sum(F.col("n") - 1).alias("repeats"), F.sum("n").alias("filled"))
    too_long = terms.where("long").groupBy("upload").agg(F.min("row").alias("long_row"))
    uploads = cells.select("upload").distinct()
    rows = uploads.join(shape, "upload", "left").join(told, "upload", "left").join(too_long, "upload", "left")
    letters = F.array_join(F.transform("columns", column_letter), ", ")
    reason = (
        F.when(F.col("columns").isNull(), "layout_invalid: empty")
        .when(F.get("columns", F.lit(0)) != 0, F.concat(F.lit("layout_invalid: terms in "), letters))
        .when(F.size("columns") > 1, F.concat(F.lit("layout_invalid: data in "), letters))
        .when(F.col("header").isNull(), "layout_invalid: no header")
        .when(F.col("long_row").isNotNull(), F.concat(F.lit("term_too_long: row "), F.col("long_row").cast("string")))
        .when(F.col("terms").isNull(), "layout_invalid: no terms")
        .when(F.size("terms") > MAX_TERMS, F.concat(F.lit("too_many_terms: "), F.size("terms").cast("string")))
    )
    blanks = F.col("last") - 1 - F.col("filled")
    named = F.regexp_replace(fold(F.col("header")), "^[ :.]+|[ :.]+$", "").isin(HEADER_WORDS)
    notes = F.array(F.when(~named, F.concat(F.lit("header not searched: "), "header")), F.when(blanks > 0, F.concat(blanks.cast("string"), F.lit(" blank"))), F.when(F.col("repeats") > 0, F.concat(F.col("repeats").cast("string"), F.lit(" repeated"))))
    good = reason.isNull()
    return rows.select("upload", reason.alias("reason"), F.when(good, F.col("terms")).alias("terms"), F.when(good, F.filter(notes, lambda n: n.isNotNull())).alias("notes"))


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """Terms or stopwords from lines of JSON, in order of the file."""
    return spark.read.json(path)


def word_list(records: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """Items of a word-list workbook (row, record: map of header to cell): fields by their headers, equivalents as arrays."""
    key = lambda h: F.regexp_replace(fold(h), " ", "")
    entries = F.transform(F.map_entries("record"), lambda e: F.struct(key(e["key"]).alias("key"), cell(e["value"]).alias("value")))
    value = lambda names: F.coalesce(F.get(F.filter(F.transform(F.array(*map(F.lit, names)), lambda n: F.get(F.filter(F.col("_qm_e"), lambda e: e["key"] == n), F.lit(0))["value"]), lambda v: v.isNotNull()), F.lit(0)), F.lit(""))
    rows = records.select("row", entries.alias("_qm_e"))
    made = rows.select("row", *(value(names).alias(f) for f, names in aliases.items()))
    made = made.where(F.concat_ws("", *aliases) != "")
    if "equivalents" in aliases:
        made = made.withColumn("equivalents", F.filter(F.transform(F.split("equivalents", r"[,;|\n]"), lambda t: F.trim(t)), lambda e: e != ""))
    return made


def _first_failure(tests: list[tuple[Column, str]]) -> Column:
    out = F.lit(None).cast("string")
    for test, code in reversed(tests):
        out = F.when(test, code).otherwise(out)
    return out


def check_terms(items: DataFrame) -> DataFrame:
    """``items`` (row from 1, term, equivalents, domain, note), cleaned, with the failure of each; the list is refused for its first."""
    bare = items.select("row", F.trim(F.coalesce("term", F.lit(""))).alias("term"), F.array_distinct(F.filter(F.transform("equivalents", lambda t: F.trim(t)), lambda e: e != "")).alias("equivalents"), *(F.trim(F.coalesce(c, F.lit(""))).alias(c) for c in ("domain", "note")))
    before = F.row_number().over(Window.partitionBy(fold(F.col("term"))).orderBy("row")) > 1
    size = F.coalesce(F.size("equivalents"), F.lit(0))
    tests = [
        (F.col("term") == "", "vocabulary_term_empty"), (F.length("term") > MAX_TERM, "vocabulary_value_too_long"), (size == 0, "vocabulary_term_without_equivalents"), (size > MAX_EQUIVALENTS, "vocabulary_too_many_equivalents"),
        (F.exists("equivalents", lambda e: F.length(e) > MAX_TERM), "vocabulary_value_too_long"), (F.length("domain") > MAX_DOMAIN, "vocabulary_value_too_long"), (F.length("note") > MAX_NOTE, "vocabulary_value_too_long"), (F.col("repeated"), "vocabulary_term_duplicate"),
    ]
    return bare.withColumn("repeated", before).withColumn("failure", _first_failure(tests)).drop("repeated")


def check_stopwords(items: DataFrame) -> DataFrame:
    """``items`` (row, word, group): blank ones and repeats gone, each with its failure."""
    bare = items.select("row", *(F.trim(F.coalesce(c, F.lit(""))).alias(c) for c in ("word", "group"))).where("word <> ''")
    tests = [(F.col("word").rlike(r"(?U)\s"), "vocabulary_stopword_not_single_word"), (F.length("word") > MAX_WORD, "vocabulary_value_too_long"), (F.length("group") > MAX_GROUP, "vocabulary_value_too_long")]
    told = bare.withColumn("failure", _first_failure(tests))
    return told.groupBy(fold(F.col("word")).alias("_qm_k")).agg(F.min(F.struct("row", "word", "group", "failure")).alias("f")).select("f.*")


def refused(checked: DataFrame) -> DataFrame:
    """One row: the first row that fails and why, or nulls; too many items fail as a whole."""
    first = checked.agg(F.min(F.when(F.col("failure").isNotNull(), F.struct("row", "failure"))).alias("f"), F.count(F.lit(1)).alias("n"))
    return first.select(F.col("f.row").alias("row"), F.when(F.col("n") > MAX_ITEMS, "vocabulary_too_many_items").otherwise(F.col("f.failure")).alias("failure"))
