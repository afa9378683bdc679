"""What an analyst's answer is given and held against: the catalog, a table's material, look-alikes, names in texts, picks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymap.functions import text as X
from quarrymap.operators.scoring import NOT_FOUND, PARTIAL, confidence

# Limits, structural columns, words of narrow tables and of remarks on spelling, patterns of names in texts.
DETAILED, FULL_TABLE, DESCRIPTION = 8, 90, 420
SPREAD_TABLES, SPREAD_SHOWN = 4, 8
PER_TABLE, LOOK_ALIKES = 10, 60
SHORTLIST, CONFUSABLES, TERMS = 14, 6, 12
LEAST_CONFIDENCE = 0.5
STRUCTURAL = ["customerpartyid", "customerid", "accountnumber", "accountsuffix", "cardrefnumber", "maincustomerid", "maincustomerpartyid", "contractid", "datadate", "period", "trandate", "trndate", "transactiondate", "reportdate"]
NARROW = ["model girdisi", "modeli girdisi", "egitim verisi", "egitim seti", "akilli hedefleme", "ozel bankacilik musterileri", "segmentasyonu girdisi"]
SPELLING = ["yazim hata", "yazim yanlis", "typo"]
FULL_NAME = r"(?U)\b[A-Za-z_]\w*\.[A-Za-z_]\w*\.[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)?\b"
SHORT_NAME = r"(?U)\b(?:v|rpt_)[A-Z]\w*\.[A-Za-z_]\w*\b"
BARE_NAME = r"(?U)\b(?:v|rpt_)[A-Z][A-Za-z0-9_]*\b(?!\*)"
VERDICT_START = r"^\s*(?:KISMEN VAR|VAR|BULUNAMADI|YOK)\b[\s.:—–-]*"


def main_group(columns: DataFrame) -> DataFrame:
    """(object_key, group): the most frequent group of a table's columns, of equals the one seen first; - for none."""
    counts = columns.where("dataset_group <> ''").groupBy("object_key", "dataset_group").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    best = counts.groupBy("object_key").agg(F.max_by("dataset_group", F.struct("n", -F.col("first"))).alias("group"))
    return columns.select("object_key").distinct().join(best, "object_key", "left").select("object_key", F.coalesce("group", F.lit("-")).alias("group"))


def catalog(columns: DataFrame, profiles: DataFrame) -> DataFrame:
    """(id, object_key, line): one line for each table, T1.. in order of the keys; what it holds, or else its columns.

    ``profiles``: object_key, description, grain, time_columns, group. A catalog has some hundred lines; they are numbered together.
    """
    tables = columns.groupBy("object_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "column_name"))), lambda c: c["column_name"]).alias("names"))
    rows = tables.join(main_group(columns), "object_key").join(profiles.withColumnRenamed("group", "profile_group"), "object_key", "left")
    id = F.concat(F.lit("T"), F.row_number().over(Window.orderBy("object_key")).cast("string"))
    told = F.coalesce("description", F.lit("")) != ""
    when = lambda test, *c: F.when(test, F.concat(*c))
    line = F.concat_ws(
        " | ", id, "object_key", F.coalesce(F.when(F.col("profile_group") != "", F.col("profile_group")), F.col("group")), F.when(told, F.col("description")),
        when(told & (F.col("grain") != ""), F.lit("Satır: "), "grain"), when(told & (F.size("time_columns") > 0), F.lit("Zaman: "), F.array_join("time_columns", ", ")), when(~told, F.lit("Kolonlar: "), F.array_join("names", ", ")),
    )
    return rows.select(id.alias("id"), "object_key", line.alias("line"))


def spread(columns: DataFrame, least: int = SPREAD_TABLES, most: int = SPREAD_SHOWN) -> DataFrame:
    """(column_name, tables): the names that the most tables have, in ``least`` or more."""
    counts = columns.groupBy("column_name").agg(F.count_distinct("object_key").alias("tables")).where(F.col("tables") >= least)
    return counts.orderBy(F.desc("tables"), "column_name").limit(most)


def table_material(asked: DataFrame, columns: DataFrame, detailed: int = DETAILED, full: int = FULL_TABLE) -> DataFrame:
    """(query, object_key, place, id, part): for each table in question its columns in order, and which are shown in detail,
    in brief or by name only. ``asked``: query, object_key, id, relative, for columns that words found."""
    tables = asked.select("query", "object_key").distinct()
    rows = columns.join(tables, "object_key").join(asked.select("query", "id", "relative"), ["query", "id"], "left").withColumn("relative", F.coalesce("relative", F.lit(0.0)))
    structural = X.fold(F.col("column_name")).isin(STRUCTURAL)
    place = F.row_number().over(Window.partitionBy("query", "object_key").orderBy(F.desc("relative"), (~structural).cast("int"), "id"))
    sizes = columns.groupBy("object_key").agg(F.count(F.lit(1)).alias("size"))
    rows = rows.withColumn("place", place).join(sizes, "object_key")
    part = F.when((F.col("size") > full) & (F.col("place") > full), "name").when((F.col("place") <= detailed) & (F.col("relative") > 0), "detail").otherwise("brief")
    return rows.select("query", "object_key", "place", "id", part.alias("part"))


def look_alikes(asked: DataFrame, candidates: DataFrame, marked: DataFrame, per_table: int = PER_TABLE, most: int = LOOK_ALIKES) -> DataFrame:
    """(query, id, part): columns outside the candidates that words or terms find: up to ``per_table`` of each marked table, then ``most``.

    ``asked``: query, object_key, id, worth. ``candidates`` and ``marked``: query, object_key.
    """
    pool = asked.where("worth > 0").join(candidates.select("query", "object_key"), ["query", "object_key"], "left_anti")
    order = [F.desc("worth"), "id"]
    own = pool.join(marked.select("query", "object_key").distinct(), ["query", "object_key"], "left_semi")
    own = own.withColumn("r", F.row_number().over(Window.partitionBy("query", "object_key").orderBy(*order))).where(F.col("r") <= per_table).select("query", "id", F.lit("table").alias("part"))
    rest = pool.join(own, ["query", "id"], "left_anti")
    rest = rest.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("r") <= most).select("query", "id", F.lit("column").alias("part"))
    return own.unionByName(rest)


def narrow_tables(descriptions: DataFrame) -> DataFrame:
    """The tables (object_key, description) that say they hold a narrow population."""
    return descriptions.where(X.fold(F.col("description")).rlike("|".join(NARROW))).select("object_key")


def resolve_tables(raw: DataFrame, known: DataFrame) -> DataFrame:
    """``raw`` (with a column raw) and object_key: by id, by full key, or by a bare name that is unique among ``known`` (id, object_key); null otherwise."""
    bare = F.regexp_replace(F.trim("raw"), "^[`'\"]+|[`'\"]+$", "")
    rows = raw.withColumn("_qm_raw", bare)
    names = known.withColumn("n", X.fold(F.element_at(F.split("object_key", r"\."), F.lit(-1)))).groupBy("n").agg(F.count(F.lit(1)).alias("c"), F.min("object_key").alias("k3")).where("c = 1").select("n", "k3")
    found = rows.join(known.select(F.col("id").alias("_qm_raw"), F.col("object_key").alias("k1")), "_qm_raw", "left").join(known.select(F.col("object_key").alias("_qm_raw"), F.col("object_key").alias("k2")), "_qm_raw", "left")
    found = found.join(names, X.fold(F.col("_qm_raw")) == F.col("n"), "left")
    return found.select(*(F.col(f"`{c}`") for c in raw.columns), F.coalesce("k1", "k2", "k3").alias("object_key"))


def resolve_columns(raw: DataFrame, columns: DataFrame) -> DataFrame:
    """``raw`` (object_key, raw ..) and the id of the column: by name, else by the first whose folded name is the same."""
    name = F.element_at(F.split(F.regexp_replace(F.trim("raw"), "^[`'\"]+|[`'\"]+$", ""), r"\."), F.lit(-1))
    rows = raw.withColumn("_qm_name", name)
    exact = columns.groupBy("object_key", F.col("column_name").alias("_qm_name")).agg(F.min("id").alias("a"))
    loose = columns.groupBy("object_key", X.fold(F.col("column_name")).alias("f")).agg(F.min("id").alias("b"))
    found = rows.join(exact, ["object_key", "_qm_name"], "left").withColumn("f", X.fold(F.col("_qm_name"))).join(loose, ["object_key", "f"], "left")
    return found.select(*(F.col(f"`{c}`") for c in raw.columns), F.coalesce("a", "b").alias("id"))


def shortlist(replies: DataFrame, known: DataFrame, most: int = SHORTLIST, confusables: int = CONFUSABLES) -> DataFrame:
    """(query, part, place, object_key) of the tables that replies pick, known ones only, each once, and (query, 'unknown', n, null).

    ``replies``: query, candidates, confusables (arrays of ids). Confusables that are candidates are left out.
    """
    each = replies.select("query", F.lit("candidate").alias("part"), F.posexplode("candidates").alias("pos", "raw")).unionByName(replies.select("query", F.lit("confusable").alias("part"), F.posexplode("confusables").alias("pos", "raw")))
    told = resolve_tables(each, known)
    unknown = told.where("object_key is null").groupBy("query").agg(F.count(F.lit(1)).cast("int").alias("place")).select("query", F.lit("unknown").alias("part"), "place", F.lit(None).cast("string").alias("object_key"))
    once = told.where("object_key is not null").groupBy("query", "part", "object_key").agg(F.min("pos").alias("pos"))
    ranked = once.withColumn("place", F.row_number().over(Window.partitionBy("query", "part").orderBy("pos")))
    cut = ranked.where(F.col("place") <= F.when(F.col("part") == "candidate", most).otherwise(confusables)).select("query", "part", "place", "object_key")
    both = cut.where("part = 'confusable'").join(cut.where("part = 'candidate'").select("query", "object_key"), ["query", "object_key"], "left_anti")
    return cut.where("part = 'candidate'").unionByName(both.select(*cut.columns)).unionByName(unknown)


def validated(hits: DataFrame, known: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(hits whose key is known, one row with the number of the others)."""
    held = known.select(*key).distinct()
    return hits.join(held, key, "left_semi"), hits.join(held, key, "left_anti").agg(F.count(F.lit(1)).alias("dropped"))


def checked_texts(texts: DataFrame, columns: DataFrame) -> DataFrame:
    """(id, text, dropped): texts without the sentences that name a table or column which does not exist.

    Names are full (a table's key, with or without a column), short (table.column) or bare (a table); full ones are taken
    first, and what is left of the sentence is read for the others.
    """
    sentence = texts.select("id", F.posexplode(X.sentences(F.trim(F.coalesce("text", F.lit(""))))).alias("pos", "s"))
    cut = lambda c, pattern: F.regexp_replace(c, pattern, " ")
    found = lambda c, pattern: F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    sentence = sentence.withColumns({"full": found(F.col("s"), FULL_NAME), "rest": cut(F.col("s"), FULL_NAME)})
    sentence = sentence.withColumns({"short": found(F.col("rest"), SHORT_NAME), "bare": found(cut(F.col("rest"), SHORT_NAME), BARE_NAME)})
    kinds = F.concat(*map(_labelled, ("full", "short", "bare")))
    each = sentence.select("id", "pos", F.explode(kinds).alias("m")).select("id", "pos", "m.*")
    parts = F.split("name", r"\.")
    # A full name of three parts is a table's key, or schema, table and column of one.
    tail = F.concat_ws(".", F.element_at(parts, -2), F.element_at(parts, -1))
    each = each.withColumn("other", F.when((F.col("kind") == "full") & (F.size(parts) == 3), tail))
    short = columns.select(F.concat_ws(".", "object_name", "column_name").alias("name"))
    known = [columns.select(F.lit("full").alias("kind"), F.col("object_key").alias("name")), columns.select(F.lit("full"), F.concat_ws(".", "object_key", "column_name")), short.select(F.lit("short"), "name"), columns.select(F.lit("bare"), F.col("object_name"))]
    held = known[0]
    for more in known[1:]:
        held = held.unionAll(more)
    bad = each.join(held.distinct(), ["kind", "name"], "left_anti").join(short.distinct().withColumnRenamed("name", "other"), "other", "left_anti").select("id", "pos").distinct()
    told = sentence.select("id", "pos", "s").join(bad.withColumn("bad", F.lit(True)), ["id", "pos"], "left")
    kept = F.filter(F.array_sort(F.collect_list(F.struct("pos", F.when(F.col("bad").isNull(), F.col("s")).alias("s")))), lambda x: x["s"].isNotNull())
    clean = told.groupBy("id").agg(F.trim(F.array_join(F.transform(kept, lambda x: x["s"]), " ")).alias("text"), F.count("bad").alias("dropped"))
    return texts.select("id").join(clean, "id", "left").select("id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("dropped", F.lit(0)).alias("dropped"))


def _labelled(kind: str) -> Column:
    return F.transform(kind, lambda n: F.struct(F.lit(kind).alias("kind"), n.alias("name")))


def without_spelling(text: Column) -> Column:
    """A text without its sentences on misspelt names."""
    return F.trim(F.array_join(F.filter(X.sentences(F.coalesce(text, F.lit(""))), lambda s: ~X.fold(s).rlike("|".join(SPELLING))), " "))


def build_answer(replies: DataFrame, picks: DataFrame, core: DataFrame, narrow: DataFrame, top: int = 5, least: float = LEAST_CONFIDENCE) -> tuple[DataFrame, DataFrame]:
    """(answers: query, verdict, summary; suggestions: query, rank, object_key, confidence).

    ``replies``: query, verdict, summary, core_found. ``picks``: query, pos, object_key, confidence (as written), n_columns,
    already resolved. ``core``: query, object_key, named (one row for each column that carries the core; a row with a null
    table for a reply that lists none that exists). A reply whose core isn't there suggests nothing; tables that hold more of
    the core go first, general ones before ``narrow`` ones, and a table that moves up has at least the confidence it passed.
    """
    sure = confidence(F.col("confidence"))
    good = picks.where("object_key is not null and n_columns > 0").withColumn("confidence", sure).where(F.col("confidence") >= least)
    once = good.groupBy("query", "object_key").agg(F.min_by(F.struct("confidence", "pos"), "pos").alias("f")).select("query", "object_key", "f.*")
    best = once.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("confidence"), "pos"))).where(F.col("r") <= top)
    held = core.groupBy("query").agg(F.count("object_key").alias("cores"))
    told = replies.join(held, "query", "left")
    said_none = (F.trim(F.coalesce("verdict", F.lit(""))) == NOT_FOUND) | ~F.coalesce("core_found", F.lit(True)) | (F.coalesce(F.col("cores"), F.lit(1)) == 0)
    told = told.withColumn("none", said_none)
    open_ = best.join(told.where("not none").select("query"), "query", "left_semi")
    weight = core.where("object_key is not null").groupBy("query", "object_key").agg(F.count(F.lit(1)).alias("held"))
    rows = open_.join(weight, ["query", "object_key"], "left").join(narrow.select("object_key").distinct().withColumn("is_narrow", F.lit(1)), "object_key", "left")
    any_held = rows.groupBy("query").agg(F.max(F.coalesce("held", F.lit(0))).alias("most"), F.max("confidence").alias("top_confidence"))
    rows = rows.join(any_held, "query")
    led = F.col("most") > 0
    order = [F.when(led, -F.coalesce("held", F.lit(0))).otherwise(0), F.when(led, F.coalesce("is_narrow", F.lit(0))).otherwise(0), F.desc("confidence"), "r"]
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order)))
    shown = ranked.select("query", "rank", "object_key", F.when(led & (F.col("rank") == 1), F.col("top_confidence")).otherwise(F.col("confidence")).alias("confidence"))
    found = shown.select("query").distinct().withColumn("any", F.lit(True))
    answers = told.join(found, "query", "left")
    said = F.when(F.trim("verdict").isin("VAR", PARTIAL, NOT_FOUND), F.trim("verdict")).otherwise(PARTIAL)
    stands = F.when(F.col("any").isNull(), NOT_FOUND).when(said == NOT_FOUND, PARTIAL).otherwise(said)
    body = F.when(F.col("any").isNull() & (said != NOT_FOUND) & ~F.col("none"), "Talebi karşılayan, sözlükte doğrulanmış bir tablo bulunamadı.").otherwise(F.coalesce("summary", F.lit("")))
    text = F.trim(F.concat(stands, F.lit(". "), F.trim(F.regexp_replace(body, VERDICT_START, ""))))
    return answers.select("query", stands.alias("verdict"), text.alias("summary")), shown
