"""Queries around a dictionary's upkeep: imports, checks, curation, catalogs, answers, versions and pictures, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrymap.functions import keys, layout
from quarrymap.functions import text as X
from quarrymap.functions.replies import parsed
from quarrymap.operators import analyst, curation, lineage, names
from quarrymap.operators.scoring import confidence
from quarrymap.plans import dictionary as D
from quarrymap.plans import sqltext as Q
from quarrymap.session import shared_folder, table
from quarrymap.sinks import store as S
from quarrymap.sources import catalog as C
from quarrymap.sources import dictionary as U

T = "«text»"


def _sql(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    return spark.sql(sql.replace(T, "STRING"), **{t: table(spark, sf_dir, t) for t in tables})


def _plain(sql: str, *tables: str) -> str:
    for t in tables:
        sql = sql.replace("{" + t + "}", t)
    return sql.replace(T, "VARCHAR")


# ------------------------------------------------------------------ texts

def column_letters(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", X.column_letter(F.col("p_partkey")).alias("letters"))


def like_patterns(spark, sf_dir):
    """Texts as patterns that match only themselves."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws("_", "p_name", F.concat(F.col("p_size").cast("string"), F.lit("%"))).alias("t"))
    return part.select("p_partkey", X.escape_like(F.col("t")).alias("pattern"), F.expr("t LIKE regexp_replace(t, '([\\\\\\\\%_])', '\\\\\\\\$1')").alias("matches"))


def short_texts(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", X.clip_plain(F.concat_ws(", ", "p_name", "p_type", "p_brand"), 20).alias("clipped"))


def name_candidates(spark, sf_dir):
    """The 150 most frequent parts of names that the vocabulary doesn't know."""
    c = D.columns(spark, sf_dir)
    every = c.select(F.explode(X.name_parts(F.col("column_name"))).alias("part")).unionAll(c.select("object_key", "object_name").distinct().select(F.explode(X.name_parts(F.col("object_name")))))
    known = D.vocabulary(spark).select(F.explode(F.concat(F.array("term"), "equivalents")).alias("k")).select(X.fold(F.col("k")).alias("k"))
    counts = every.groupBy("part").agg(F.count(F.lit(1)).alias("n")).withColumn("k", X.fold(F.col("part"))).join(F.broadcast(known), "k", "left_anti")  # a bounded list
    return counts.orderBy(F.desc("n"), "part").limit(150).select("part", "n")


TERMS = ["ring", "red", "oran", "müşteri", "xx"]


def term_hits(spark, sf_dir):
    """How many of a question's terms each column mentions."""
    return D.columns(spark, sf_dir).select("id", X.term_hits(F.array(*map(F.lit, TERMS)), F.col("column_name"), F.col("description")).cast("long").alias("hits"))


def column_notes(spark, sf_dir):
    """The sentences of a warning that name a column."""
    c = D.columns(spark, sf_dir)
    texts = F.array(F.concat(F.lit("Uyarı: "), "column_name", F.lit(" seyrek dolar. Diğer kolonlar dolu. ör. "), "column_name", F.lit("X başka bir kolondur.")))
    return c.select("id", F.array_join(X.sentences_naming(F.col("column_name"), texts), " | ").alias("notes"))


#: Whole replies, replies in asides and fences, in prose, and none.
REPLIES = """CASE o_orderkey % 5 WHEN 0 THEN '{"a":' || o_custkey || '}' WHEN 1 THEN '<think>{"a":0}</think> ```json\n{"a":' || o_custkey || '}\n```' WHEN 2 THEN 'Cevap: {"a":' || o_custkey || '} son' WHEN 3 THEN '[1,2]' ELSE 'yok {' END"""


def parsed_replies(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", parsed(F.expr(REPLIES)).alias("json"))


def confidences(spark, sf_dir):
    made = _sql(spark, sf_dir, "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN CAST(p_size / 25.0 AS STRING) WHEN 1 THEN 'high' WHEN 2 THEN NULL WHEN 3 THEN '-0.5' ELSE '0.75' END AS said FROM {part}", "part")
    return made.select("p_partkey", F.round(confidence(F.col("said")), 6).alias("confidence"))


# ------------------------------------------------------------------ imports

IMPORT = """SELECT p_partkey AS pos, CASE WHEN p_partkey % 17 = 0 THEN ' ' ELSE 'DWH' END AS DatabaseName, p_type AS SchemaName, p_brand AS ObjectName, CASE WHEN p_partkey % 19 = 0 THEN NULL ELSE p_name END AS ColumnName,
 p_name || ' alanı' AS ColumnDescription, p_name || ', ' || lower(p_type) || '.' AS Synonyms, CAST(p_size AS DOUBLE) AS Role FROM {part}"""
OBJECTS = """SELECT CAST(p_partkey AS BIGINT) AS pos, CASE WHEN p_partkey % 3 = 0 THEN 'DWH.' || p_type || '.' || p_brand END AS ObjectKey, 'DWH' AS DatabaseName, p_type AS SchemaName, p_brand AS ObjectName, p_name AS ObjectDescription, 'Satır, ay' AS Grain,
 'Period, ,DataDate' AS TimeColumns, CASE WHEN p_size > 25 THEN 'Grup ' || CAST(p_size % 4 AS «text») END AS DatasetGroup FROM {part}"""


def imported_columns(spark, sf_dir):
    """The dictionary of an upload: first rows of whole keys, with dense ids, synonyms and the groups of their objects."""
    profiles = U.object_profiles(_sql(spark, sf_dir, OBJECTS, "part"))
    kept, _ = U.build_columns(_sql(spark, sf_dir, IMPORT, "part"), profiles.where("group <> ''").select("object_key", "group"))
    return kept.select("id", "key", F.array_join("synonym_list", " | ").alias("synonyms"), "Role", "dataset_group")


def import_warnings(spark, sf_dir):
    return U.build_columns(_sql(spark, sf_dir, IMPORT, "part"))[1]


def object_profiles(spark, sf_dir):
    """The last row of every object."""
    return U.object_profiles(_sql(spark, sf_dir, OBJECTS, "part")).select("object_key", "description", "grain", F.array_join("time_columns", ",").alias("time_columns"), "group")


UPLOADS = """SELECT n_regionkey AS upload, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS INT) AS row, array(CASE WHEN n_nationkey < 5 THEN CASE WHEN n_regionkey = 1 THEN NULL WHEN n_regionkey = 2 THEN 'Terimler:' ELSE 'Başlık' END
 WHEN n_regionkey = 3 AND n_nationkey = 13 THEN repeat('x', 501) WHEN n_nationkey % 5 = 4 AND n_nationkey > 10 THEN ' ' || upper(n_name) || ' ' WHEN n_nationkey % 7 = 0 THEN NULL ELSE n_name END, CASE WHEN n_regionkey = 0 AND n_nationkey > 15 THEN 'extra' END) AS cells FROM {nation}"""


def term_lists(spark, sf_dir):
    """What five uploads of terms give, or why they are refused."""
    told = U.term_list(_sql(spark, sf_dir, UPLOADS, "nation"))
    return told.select("upload", "reason", F.array_join("terms", ",").alias("terms"), F.array_join("notes", "; ").alias("notes"))


ITEMS = """SELECT CAST(p_partkey + 1 AS INT) AS row, CASE WHEN p_partkey % 41 = 40 THEN ' ' ELSE p_name || ' ' || CAST(p_partkey % 190 AS «text») END AS term, array(CASE WHEN p_partkey % 53 = 52 THEN ' ' ELSE p_type END, p_brand, CASE WHEN p_partkey % 53 = 52 THEN '' ELSE p_type END) AS equivalents, '' AS domain,
 CASE WHEN p_partkey % 97 = 96 THEN repeat('n', 1001) ELSE '' END AS note FROM {part}"""


def vocabulary_checks(spark, sf_dir):
    """Every term of a list with the reason why it can't stay."""
    return U.check_terms(_sql(spark, sf_dir, ITEMS, "part")).select("row", "term", F.size("equivalents").cast("long").alias("n_equivalents"), "failure")


def vocabulary_refusal(spark, sf_dir):
    return U.refused(U.check_terms(_sql(spark, sf_dir, ITEMS, "part")))


def stopword_checks(spark, sf_dir):
    items = _sql(spark, sf_dir, "SELECT CAST(p_partkey + 1 AS INT) AS row, CASE WHEN p_partkey % 11 = 0 THEN ' ' WHEN p_partkey % 13 = 0 THEN p_name ELSE upper(split_part(p_name, ' ', 1)) || CAST(p_partkey % 30 AS STRING) END AS word, p_type AS group FROM {part}", "part")
    return U.check_stopwords(items)


def word_list(spark, sf_dir):
    """Terms of a workbook's records by the names of its headers."""
    rows = _sql(spark, sf_dir, "SELECT CAST(p_partkey AS INT) AS row, map('Terim', p_name, 'EŞ DEĞERLER', p_type || ' ; ' || p_brand || '|', 'ALAN', CASE WHEN p_size > 25 THEN 'ürün' END, 'x', 'y') AS record FROM {part}", "part")
    made = U.word_list(rows, U.TERM_HEADERS)
    return made.select("row", "term", F.array_join("equivalents", "+").alias("equivalents"), "domain", "note")


# ------------------------------------------------------------------ sources and names

SOURCE_TABLES = """SELECT ' DWH ' AS database, n_name AS schema, CASE WHEN s_suppkey % 9 = 0 THEN 'null' ELSE 'Warehouse' || translate(CAST(s_suppkey AS «text»), '0123456789', 'abcdefghij') END AS name, s_name AS description FROM {supplier} JOIN {nation} ON n_nationkey = s_nationkey"""


def source_definitions(spark, sf_dir):
    """Trimmed definitions with a full key, in an order of their own."""
    rows, _ = C.definitions(_sql(spark, sf_dir, SOURCE_TABLES, "supplier", "nation"), ["database", "schema", "name"])
    return rows.select("pos", "schema", "name", "description")


def source_probe(spark, sf_dir):
    """How much a read would bring, and the latest change."""
    tables = _sql(spark, sf_dir, "SELECT 'DWH' AS database, c_mktsegment AS schema, c_name AS name, o_orderdate AS changed FROM {customer} JOIN {orders} ON o_custkey = c_custkey", "customer", "orders")
    columns = _sql(spark, sf_dir, "SELECT 'DWH' AS database, p_type AS schema, p_brand AS table, p_name AS name, TIMESTAMP '1990-01-01 00:00:00' AS changed FROM {part}", "part")
    return C.probe(tables, columns, "changed")


def source_catalog(spark, sf_dir):
    """Views with their columns; procedures, whose columns nobody sees."""
    objects = _sql(spark, sf_dir, "SELECT DISTINCT 'DWH' AS database, p_type AS schema, p_brand AS name, CASE WHEN p_brand LIKE '%3' THEN 'P ' ELSE 'V ' END AS type FROM {part}", "part")
    columns = _sql(spark, sf_dir, "SELECT 'DWH' AS database, p_type AS schema, p_brand AS table, p_name AS name FROM {part}", "part")
    return C.catalog(objects, columns).select("schema", "name", F.size("columns").alias("n_columns"), F.array_join("columns", ",").alias("columns"))


SPELLED = """SELECT 'dwh1' AS database, CASE WHEN s_suppkey % 6 = 0 THEN lower(n_name) || ' ' WHEN s_suppkey % 6 = 1 THEN 'Elsewhere' ELSE n_name END AS schema,
 CASE s_suppkey % 6 WHEN 2 THEN replace(name, 'house', 'hose') WHEN 3 THEN upper(name) WHEN 4 THEN name || '7' ELSE name END AS name FROM
 (SELECT s_suppkey, s_nationkey, 'Warehouse' || translate(CAST(s_suppkey AS «text»), '0123456789', 'abcdefghij') || 'Table' || translate(CAST(s_suppkey AS «text»), '0123456789', 'jihgfedcba') AS name FROM {supplier}) JOIN {nation} ON n_nationkey = s_nationkey"""
PLACES = """SELECT 'DWH1' AS database, n_name AS schema, 'Warehouse' || translate(CAST(s_suppkey AS «text»), '0123456789', 'abcdefghij') || 'Table' || translate(CAST(s_suppkey AS «text»), '0123456789', 'jihgfedcba') AS name FROM {supplier} JOIN {nation} ON n_nationkey = s_nationkey"""


def located_tables(spark, sf_dir):
    """Where the catalog has each spelling of a table."""
    databases = spark.createDataFrame([("dwh1", "DWH1")], "database string, to_database string")
    return names.locate(_sql(spark, sf_dir, SPELLED, "supplier", "nation"), databases, _sql(spark, sf_dir, PLACES, "supplier", "nation")).select("schema", "name", "to_schema", "to_name")


# ------------------------------------------------------------------ curation

#: What descriptions say, in turn, and what the rules leave of it.
TEXTS = [
    ("Müşterinin şube kodudur. Değerin anlamı iş birimi ile doğrulanmalıdır.", "Müşterinin şube kodudur.", True),
    ("Kayıt tarihidir; kapsamı iş birimi ile doğrulanmalıdır.", "Kayıt tarihidir.", True),
    ("Kartın EMV bayrağı olması beklenmektedir.", "Kartın EMV bayrağı.", True),
    ("Kredinin faiz oranıdır. Değer boş olabilir.", "Fon kullandırımının kar payı oranıdır.", True),
    ("Tutar genellikle ay sonu bakiyesidir.", "Tutar ay sonu bakiyesidir.", True),
    ("Temlik türünün okunabilir adıdır.", "Temlik türünün okunabilir adıdır.", False),
    ("Şube kodudur. Şube bazlı analizlerde temel kırılım olarak kullanılır.", "Şube kodudur.", False),
    ("Leasing fon ödemesinin tarihidir.", "İcare fon ödemesinin tarihidir.", False),
    ("Şube adıdır. Eş anlamlılar/aranabilir terimler: şube, branch.", "Şube adıdır.", False),
    ("Döviz kodudur (ör. TRY, USD).", "Döviz kodudur (ör. TRY, USD).", False),
    ("", "", False),
    ("Kod 'Bireysel Krediler' yazar.", "Kod 'Bireysel Krediler' yazar.", False),
]


def _texts(spark, sf_dir):
    said = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(TEXTS)], "k int, description string")
    part = table(spark, sf_dir, "part")
    rows = part.select(F.col("p_partkey").alias("pos"), F.col("p_brand").alias("object_key"), F.concat_ws("_", "p_name", F.col("p_partkey").cast("string")).alias("column_name"), (F.col("p_partkey") % len(TEXTS)).cast("int").alias("k"), "p_size")
    rows = rows.join(F.broadcast(said), "k")
    return rows.withColumns({
        "synonyms": F.when(F.col("p_size") % 5 == 0, F.col("description")).otherwise(F.lit("şube, branch, şube, olası kod")),
        "summary": F.when(F.col("p_size") % 7 == 0, F.lit("Kalem kodu (ör. 1.9) · olası değerler doğrulanmalı")).otherwise(F.lit("Müşteri sınıfı · Bireysel/KOBİ/Ticari/Kurumsal")),
        "description_origin": F.when(F.col("p_size") % 4 == 0, curation.ADMIN).when(F.col("p_size") % 4 == 1, curation.SOURCE).otherwise("model"), "synonyms_origin": F.lit("model"), "summary_origin": F.lit("model"),
    })


def curated_texts(spark, sf_dir):
    """Descriptions, search terms and summaries after the rules; an admin's text stays."""
    made = curation.normalized(_texts(spark, sf_dir))
    return made.select("pos", "description", "summary", F.when(F.col("p_size") % 5 > 0, F.col("synonyms")).alias("synonyms"), F.size("removed").cast("long").alias("n_removed"), F.col("description_from").isNotNull().alias("from_source"))


def curation_changes(spark, sf_dir):
    """How many fields the rules changed, by field."""
    before = _texts(spark, sf_dir)
    return curation.normalized_changes(before, curation.normalized(before)).where("field <> 'synonyms'").groupBy("field").agg(F.count(F.lit(1)).alias("n"))


OBJECT_ROWS = """SELECT min(p_partkey) AS pos, p_brand AS object_key, CASE WHEN min(p_size) % 2 = 0 THEN 'Olası tablo' ELSE 'Tablo' END AS ObjectDescription, CASE WHEN min(p_size) % 3 = 0 THEN 'Missing' ELSE '' END AS KeyColumns, '' AS TimeColumns FROM {part} GROUP BY p_brand"""


def mechanical_checks(spark, sf_dir):
    """What is wrong with a dictionary's rows, with at most five examples of each."""
    rows = _texts(spark, sf_dir).withColumn("column_name", F.when(F.col("pos") % 101 == 0, " PersonnelFlag ").otherwise(F.col("column_name")))
    found = curation.mechanical_checks(_sql(spark, sf_dir, OBJECT_ROWS, "part"), rows, ["personnelflag"])
    return found.select("check", "count", F.size("examples").cast("long").alias("n_examples"))


CARDS = """SELECT p_brand, CAST(count(CASE WHEN p_size > 30 THEN 1 END) AS INT) AS n_right, CAST(count(CASE WHEN p_size BETWEEN 20 AND 30 THEN 1 END) AS INT) AS n_minor, CAST(count(CASE WHEN p_size < 3 THEN 1 END) AS INT) AS n_wrong, CAST(count(*) AS INT) AS calls,
 CAST(count(CASE WHEN p_size = 50 THEN 1 END) AS INT) AS failures, CAST(min(p_size) % 2 AS INT) AS failed, CAST(max(p_size) % 2 AS INT) AS failed_now, CAST(count(*) AS INT) AS scope FROM {part} GROUP BY p_brand"""


def score_cards(spark, sf_dir):
    """The score and verdict of updates, the interval of their wrong share, and the score after an edit."""
    rows = _sql(spark, sf_dir, CARDS, "part")
    c = F.col
    rows = rows.withColumns(curation.score_card(c("failed"), c("n_right"), c("n_minor"), c("n_wrong"), c("calls"), c("failures"), c("scope")))
    again = curation.rescored(c("score"), c("failed"), c("failed_now"), c("n_right") + c("n_minor") + c("n_wrong"), c("scope"))
    return rows.select("p_brand", "score", "verdict", "wrong_low", "wrong_high", again["score"].alias("score_again"), again["verdict"].alias("verdict_again"))


def judge_shares(spark, sf_dir):
    """A judge's verdicts by brand."""
    said = _sql(spark, sf_dir, "SELECT p_brand, CASE p_size % 4 WHEN 0 THEN 'dogru' WHEN 1 THEN 'kucuk' WHEN 2 THEN 'hatali' ELSE 'belki' END AS verdict FROM {part}", "part")
    return curation.judged(said, ["p_brand"])


def judge_sample(spark, sf_dir):
    """A hundred rows to judge, the same whenever they are asked for."""
    return curation.sample_rows(table(spark, sf_dir, "part").select("p_partkey", "p_name"), ["p_partkey"], 100, 7)


ALIGN = """SELECT p_partkey AS object_key, CASE p_size % 3 WHEN 0 THEN 'accountnumber, Missing, AccountNumber' ELSE 'CustomerId' END AS KeyColumns, CASE WHEN p_size % 2 = 0 THEN 'datadate' ELSE 'Period' END AS TimeColumns,
 CASE p_size % 4 WHEN 0 THEN 'Müşteri × Veri tarihi' WHEN 1 THEN 'Müşteri × Periyot (ay)' WHEN 2 THEN 'Teminat' END AS Grain, CASE WHEN p_size > 25 THEN 'Kart ' ELSE 'Risk' END AS BusinessDomain FROM {part}"""


def aligned_objects(spark, sf_dir):
    """Objects whose keys and times are columns that they have."""
    objects = _sql(spark, sf_dir, ALIGN, "part")
    columns = objects.select("object_key", F.explode(F.array(*map(F.lit, ("AccountNumber", "CustomerId", "DataDate", "Period")))).alias("column_name"))
    return curation.align_objects(objects, columns, {"Kart": "Kart ve Harcama"}).select("object_key", "KeyColumns", "TimeColumns", "BusinessDomain")


# ------------------------------------------------------------------ code

DEFINITIONS = [
    ("EDWDM.SAL.vOffer", "CREATE VIEW SAL.vOffer AS SELECT o.OfferNk AS OfferId, o.Tries, CASE WHEN K.Id IS NOT NULL THEN 1 ELSE 0 END AS Staff FROM EDW.SAL.Offer o WITH (NOLOCK) LEFT JOIN EDWUTIL.DTG.KeyPerson K ON o.PersonId = K.Id WHERE o.Written >= '2025-01-01'"),
    ("EDWLRY.SAL.ins_Offer", "CREATE PROCEDURE SAL.ins_Offer AS BEGIN INSERT INTO EDWLRY.SAL.Offer (OfferNk, Tries) SELECT S.OfferId OfferNk, ISNULL(S.Tries, 0) AS Tries FROM EDWSTG.CRM.Offer AS S; END;"),
    ("EDWDM.SAL.vPlain", "CREATE VIEW SAL.vPlain AS SELECT T.OfferId FROM SAL.vOffer AS T"),
    ("EDWDM.SAL.rpt_Odd", "CREATE PROCEDURE SAL.rpt_Odd AS BEGIN\nEXEC other @Level = 3\nEND"),
]
WANTED = [("EDWDM.SAL.vOffer", "OfferId"), ("EDWDM.SAL.vOffer", "Tries"), ("EDWDM.SAL.vOffer", "Staff"), ("EDWDM.SAL.vPlain", "OfferId"), ("EDWDM.SAL.rpt_Odd", "Level"), ("EDWDM.SAL.none", "x")]


def column_lineage(spark, sf_dir):
    """How columns of a few definitions come about."""
    found = lineage.evidence(spark.createDataFrame(DEFINITIONS, "key string, body string"), spark.createDataFrame(WANTED, "object_key string, column_name string"))
    return found.select("object_key", "column_name", "kind", F.array_join("steps", " | ").alias("steps"), F.array_join("scope", " | ").alias("scope"))


def lineage_writes(spark, sf_dir):
    """What the definitions write."""
    found = lineage.writes(spark.createDataFrame(DEFINITIONS, "key string, body string"))
    return found.select("module", "table", F.array_join("columns", ",").alias("columns"), F.array_join("sources", ",").alias("sources"))


def lineage_scope(spark, sf_dir):
    """Which columns a changed load makes worth another look."""
    rows = spark.createDataFrame([(k, c, False, False) for k, c in WANTED], "object_key string, column_name string, table_is_new boolean, is_new boolean")
    old = spark.createDataFrame(DEFINITIONS, "key string, body string")
    none = spark.createDataFrame([], "object_key string, column_name string, digest string")
    before = lineage.evidence(old, rows).select("object_key", "column_name", lineage.trail_digest(F.col("steps"), F.col("scope")).alias("digest"))
    gates = lineage.gates(old, rows.select("object_key").distinct()).select("object_key", F.lit("").alias("column_name"), F.col("gate").alias("digest"))
    new = spark.createDataFrame([(k, b.replace("ISNULL(S.Tries, 0)", "ISNULL(S.Tries, 1)")) for k, b in DEFINITIONS], "key string, body string")
    return lineage.plan_scope(new, rows, none.unionByName(before).unionByName(gates)).select("object_key", "column_name", "reason")


# ------------------------------------------------------------------ answers

def catalog_lines(spark, sf_dir):
    """One line for each table, in order of the keys."""
    c = D.columns(spark, sf_dir)
    told = c.groupBy("object_key").agg(F.max(F.when(F.col("id") % 50 == 0, "Tutar tablosu").otherwise("")).alias("description"))
    profiles = told.select("object_key", "description", F.lit("müşteri").alias("grain"), F.array(F.lit("Period")).alias("time_columns"), F.lit("").alias("group"))
    return analyst.catalog(c, profiles).select("id", "object_key", F.sha2("line", 256).alias("line_sha256"))


def name_spread(spark, sf_dir):
    """The column names that most tables have."""
    return analyst.spread(D.columns(spark, sf_dir))


def main_groups(spark, sf_dir):
    return analyst.main_group(D.columns(spark, sf_dir))


def table_material(spark, sf_dir):
    """Which columns of the tables in question are shown in detail, in brief, or by name."""
    c = D.columns(spark, sf_dir)
    asked = c.where("id % 5 = 0").select(F.lit(0).alias("query"), "object_key", "id", (F.col("id") % 7 / 7.0).alias("relative"))
    return analyst.table_material(asked, c, detailed=2, full=6).select("object_key", "place", "id", "part")


def look_alikes(spark, sf_dir):
    """Columns that look like what is asked for outside the candidates."""
    c = D.columns(spark, sf_dir)
    asked = c.select((F.col("id") % 3).cast("int").alias("query"), "object_key", "id", X.term_hits(F.array(*map(F.lit, TERMS)), F.col("column_name"), F.col("description")).alias("worth"))
    held = c.select("object_key").distinct()
    queries = spark.createDataFrame([(0,), (1,), (2,)], "query int")
    candidates = queries.join(F.broadcast(held.where("object_key LIKE '%Brand1'")), F.lit(True)).select("query", "object_key")  # a handful of tables
    marked = queries.join(F.broadcast(held.where("object_key LIKE '%Brand2'")), F.lit(True)).select("query", "object_key")
    return analyst.look_alikes(asked, candidates, marked, per_table=2, most=20)


def narrow_tables(spark, sf_dir):
    rows = D.columns(spark, sf_dir).groupBy("object_key").agg(F.min("id").alias("i")).select("object_key", F.when(F.col("i") % 3 == 0, "Bu tablo MODEL GİRDİSİ olarak üretilir").when(F.col("i") % 3 == 1, "Eğitim seti").otherwise("Genel tablo").alias("description"))
    return analyst.narrow_tables(rows)


def _picks(spark, sf_dir):
    known = D.columns(spark, sf_dir).select("object_key").distinct().withColumn("id", F.concat(F.lit("T"), F.row_number().over(Window.orderBy("object_key")).cast("string")))
    return known.select("id", "object_key")


def shortlists(spark, sf_dir):
    """The tables that replies pick, by id, key or name."""
    replies = D.questions(spark, sf_dir).select("query", F.expr("transform(sequence(0, 19), i -> CASE i % 4 WHEN 0 THEN 'T' || CAST(1 + (query + i) % 40 AS STRING) WHEN 1 THEN ' `vSmallBrand' || CAST(1 + (query * i) % 30 AS STRING) || '`' WHEN 2 THEN 'T9999' ELSE 'DWH.SMALL.vSmallBrand' || CAST(1 + i % 25 AS STRING) END)").alias("candidates"), F.expr("transform(sequence(0, 5), i -> 'T' || CAST(1 + (query + i * 4) % 45 AS STRING))").alias("confusables"))
    return analyst.shortlist(replies, _picks(spark, sf_dir))


SAID = "'DWH.SMALL.vSmallBrand1 tablosu var. ' || CASE WHEN p_partkey % 2 = 0 THEN 'DWH.SMALL.vNone.Kolon kullanılır. ' ELSE '' END || CASE WHEN p_partkey % 3 = 0 THEN 'vSmallBrand1.Yok eksiktir. ' ELSE '' END || CASE WHEN p_partkey % 5 = 0 THEN 'vGhostTable bulunmaz! ' ELSE '' END || 'Hepsi bu.'"


def checked_texts(spark, sf_dir):
    """Texts without the sentences that name what the dictionary doesn't have."""
    texts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.expr(SAID).alias("text"))
    return analyst.checked_texts(texts, D.columns(spark, sf_dir))


def resolved_columns(spark, sf_dir):
    """Columns by what a reply calls them."""
    raw = D.columns(spark, sf_dir).select("object_key", F.col("id").alias("of"), F.expr("CASE id % 4 WHEN 0 THEN column_name WHEN 1 THEN '`' || upper(column_name) || '`' WHEN 2 THEN 'T1.' || column_name ELSE 'None' END").alias("raw"))
    return analyst.resolve_columns(raw, D.columns(spark, sf_dir)).select("of", "id")


def validated_hits(spark, sf_dir):
    """Labels of documents in one language, and how many others there are."""
    docs = table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id")
    kept, dropped = analyst.validated(table(spark, sf_dir, "labels"), docs, ["doc_id"])
    return kept.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(dropped))  # one row


# ------------------------------------------------------------------ versions

def _store(spark) -> S.Store:
    return S.Store(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")


def stored_answers(spark, sf_dir):
    """Answers saved one after the other: the newest of each key, and of those the newest two hundred."""
    store, orders = _store(spark), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    for half in (orders.where("o_orderkey % 2 = 0"), orders.where("o_orderkey % 2 = 1")):
        store.upsert("answers", half, ["o_custkey", "o_orderstatus"], ["o_orderdate", "o_orderkey"], 200)
    return store.read("answers", checked=True)


def stored_digests(spark, sf_dir):
    """Digests of rows after an update: new values win, and what is gone from the source goes."""
    store, part = _store(spark), table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("digest"))
    store.write("digests", part)
    store.upsert_and_drop("digests", part.where("p_partkey % 3 = 0").withColumn("digest", F.col("digest") + 1000), ["p_partkey"], part.where("p_partkey % 5 <> 0"))
    return store.read("digests")


def stored_vocabulary(spark, sf_dir):
    """A word list replaced twice."""
    store, nation = _store(spark), table(spark, sf_dir, "nation").select("n_name")
    store.replace_list("terms", nation)
    store.replace_list("terms", nation.where("n_name LIKE '%1%'"))
    return store.read("terms")


def version_life(spark, sf_dir):
    """What a table's versions are after a change, a change back by rollback, a rollback to the same, and a prune."""
    store, region = _store(spark), table(spark, sf_dir, "region")
    first = store.write("d", region, at=0.0)
    store.write("d", region.where("r_regionkey > 1"), at=86400.0)
    served = {"dictionary": store.active("d")["digest"]}
    store.rollback("d", first["id"])
    store.rollback("d", first["id"])
    frames, now = store.pinned(["d"])
    pruned = store.prune("d", 30, now=86400.0 * 40)
    changed = S.stale(served, {"dictionary": now["d"]}, ["dictionary"])
    return spark.createDataFrame([(len(store.versions("d")), frames["d"].count(), pruned, ",".join(changed))], "versions long, active_rows long, pruned long, stale string")


def retain_by_owner(spark, sf_dir):
    """The newest five lists of each owner."""
    return S.newest_of_owner(table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), "user_id", ["ts", "event_id"], 5).select("event_id", "user_id")


def dictionary_digest(spark, sf_dir):
    """The digest of all records in order, as canonical JSON."""
    return keys.canonical_digest(table(spark, sf_dir, "part"), "p_partkey", ["p_name", "p_brand", "p_type"])


# ------------------------------------------------------------------ pictures

def name_hashes(spark, sf_dir):
    """The 32-bit hashes of names."""
    return table(spark, sf_dir, "part").select("p_partkey", layout.fnv1a(F.concat(F.col("p_name"), F.lit(" ışĞ"))).alias("hash"), layout.next_state(layout.fnv1a(F.col("p_name"))).alias("next"))


def galaxy_clusters(spark, sf_dir):
    """Places of groups of tables, the largest in the middle."""
    made = layout.clusters(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("name"), F.col("p_brand").alias("group")))
    return made.select("group", "place", "n", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "hue")


STEPS = "SELECT conv_id AS trace, turn AS seq, CASE WHEN turn = 0 THEN NULL WHEN turn % 3 = 0 THEN 99 ELSE (turn - 1) DIV 2 END AS parent, length(text) AS start_ms FROM {conversations}"


def tree_order(spark, sf_dir):
    """The steps of traces in the order of their tree."""
    made = layout.tree_order(spark, _sql(spark, sf_dir, STEPS, "conversations"))
    return made.select("trace", "seq", "depth", "path")


def palette(spark, sf_dir):
    """The sixty best entries for a few words."""
    words = F.array(F.lit("red"), F.lit("ri"))
    scored = table(spark, sf_dir, "part").select("p_partkey", layout.palette_score(F.col("p_name"), F.col("p_type"), words).alias("score")).where("score is not null")
    return scored.orderBy(F.desc("score"), "p_partkey").limit(layout.PALETTE)


def exact_tables(spark, sf_dir):
    """The one table that a text names."""
    tables = D.columns(spark, sf_dir).select("object_key").distinct()
    wanted = tables.select(F.expr("CASE WHEN length(object_key) % 3 = 0 THEN upper(object_key) WHEN length(object_key) % 3 = 1 THEN ' ' || split_part(object_key, '.', 3) || ' ' ELSE split_part(object_key, '.', 1) END").alias("wanted")).distinct()
    return layout.exact_table(wanted, tables)


def replayed_events(spark, sf_dir):
    """What a reader gets that saw events up to its last id: the later ones of its own."""
    return _sql(spark, sf_dir, "SELECT e.event_id, e.user_id FROM {events} e JOIN (SELECT user_id, max(event_id) AS last FROM {events} WHERE event_type = 'signup' GROUP BY user_id) s ON s.user_id = e.user_id AND e.event_id > s.last", "events")


QUERIES = {f.__name__: f for f in (
    column_letters, like_patterns, short_texts, name_candidates, term_hits, column_notes, parsed_replies, confidences, imported_columns, import_warnings, object_profiles, term_lists, vocabulary_checks, vocabulary_refusal, stopword_checks, word_list,
    source_definitions, source_probe, source_catalog, located_tables, curated_texts, curation_changes, mechanical_checks, score_cards, judge_shares, judge_sample, aligned_objects, column_lineage, lineage_writes, lineage_scope,
    catalog_lines, name_spread, main_groups, table_material, look_alikes, narrow_tables, shortlists, checked_texts, resolved_columns, validated_hits, stored_answers, stored_digests, stored_vocabulary, version_life, retain_by_owner,
    dictionary_digest, name_hashes, galaxy_clusters, tree_order, palette, exact_tables, replayed_events,
)}

# ------------------------------------------------------------------ the same in SQL

_C = f"c AS ({D.plain(D.COLUMNS)})"
_FNV = "list_reduce(list_concat([CAST(2166136261 AS HUGEINT)], list_transform(string_split({e}, ''), lambda x: CAST(unicode(x) AS HUGEINT))), lambda h, u: (xor(CAST(h AS BIGINT), CAST(u AS BIGINT))::HUGEINT * 16777619) % 4294967296)"
_TEXT_VALUES = ", ".join(f"({i}, {Q.quoted(t)}, {Q.quoted(c)}, {str(d).lower()})" for i, (t, c, d) in enumerate(TEXTS))
_TEXT_ROWS = f"t(k, said, clean, doubtful) AS (VALUES {_TEXT_VALUES}), r AS (SELECT p_partkey AS pos, p_size, p_brand, t.* FROM part JOIN t ON k = p_partkey % {len(TEXTS)})"
_HITS = "len(list_filter([" + ", ".join(Q.quoted(t) for t in TERMS if len(t) >= 3) + f"], lambda t: contains({Q.fold('column_name')} || ' ' || {Q.fold('description')}, {Q.fold('t')})))"
_KNOWN = f"{_C}, tabs AS (SELECT object_key, 'T' || row_number() OVER (ORDER BY object_key) AS id, {Q.fold('string_split(object_key, chr(46))[3]')} AS bare FROM (SELECT DISTINCT object_key FROM c))"
ORACLES = {
    "column_letters": """
SELECT p_partkey, CASE WHEN p_partkey < 26 THEN chr(CAST(65 + p_partkey AS INT)) WHEN p_partkey < 702 THEN chr(CAST(64 + p_partkey // 26 AS INT)) || chr(CAST(65 + p_partkey % 26 AS INT))
  ELSE chr(CAST(65 + (p_partkey - 702) // 676 AS INT)) || chr(CAST(65 + ((p_partkey - 702) // 26) % 26 AS INT)) || chr(CAST(65 + (p_partkey - 702) % 26 AS INT)) END AS letters FROM part""",
    "like_patterns": r"SELECT p_partkey, replace(replace(t, '_', '\_'), '%', '\%') AS pattern, true AS matches FROM (SELECT p_partkey, p_name || '_' || p_size || '%' AS t FROM part)",
    "short_texts": "SELECT p_partkey, CASE WHEN length(t) <= 20 THEN t WHEN contains(substr(t, 1, 20), ' ') THEN rtrim(regexp_extract(substr(t, 1, 20), '^(.*) [^ ]*$', 1), ' ·,;:(') ELSE substr(t, 1, 20) END AS clipped FROM (SELECT p_partkey, p_name || ', ' || p_type || ', ' || p_brand AS t FROM part)",
    "name_candidates": f"""
WITH {_C}, p AS (SELECT unnest({Q.camel("regexp_replace(column_name, '[^A-Za-z]', ' ', 'g')")}) AS part FROM c UNION ALL SELECT unnest({Q.camel("regexp_replace(object_name, '[^A-Za-z]', ' ', 'g')")}) FROM (SELECT DISTINCT object_key, object_name FROM c)),
v AS (SELECT {Q.fold('k')} AS k FROM (VALUES {", ".join(f"({Q.quoted(w)})" for t, e, *_ in D.VOCABULARY for w in [t, *e])}) AS x(k))
SELECT part, count(*) AS n FROM p WHERE length(part) >= 3 AND {Q.fold('part')} NOT IN (SELECT k FROM v) GROUP BY part ORDER BY n DESC, part LIMIT 150""",
    "term_hits": f"WITH {_C} SELECT id, CAST({_HITS} AS BIGINT) AS hits FROM c",
    "column_notes": f"WITH {_C} SELECT id, 'Uyarı: ' || column_name || ' seyrek dolar.' AS notes FROM c",
    "parsed_replies": "SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 3 THEN '{\"a\":' || o_custkey || '}' END AS json FROM orders",
    "confidences": "SELECT p_partkey, round(greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), CASE p_partkey % 5 WHEN 0 THEN p_size / 25.0 WHEN 4 THEN 0.75 ELSE 0 END)), 6) AS confidence FROM part",
    "imported_columns": f"""
WITH s AS ({_plain(IMPORT, 'part')}), k AS (SELECT *, DatabaseName || '.' || SchemaName || '.' || ObjectName || '.' || ColumnName AS key, row_number() OVER (PARTITION BY SchemaName, ObjectName, ColumnName ORDER BY pos) AS r FROM s WHERE trim(DatabaseName) <> '' AND ColumnName IS NOT NULL),
o AS (SELECT SchemaName, ObjectName, arg_max(coalesce(DatasetGroup, ''), pos) AS grp FROM ({_plain(OBJECTS, 'part')}) GROUP BY ALL)
SELECT row_number() OVER (ORDER BY pos) - 1 AS id, key, replace(rtrim(Synonyms, '.'), ', ', ' | ') AS synonyms, CAST(CAST(Role AS INT) AS VARCHAR) AS Role, nullif(grp, '') AS dataset_group FROM k LEFT JOIN o USING (SchemaName, ObjectName) WHERE r = 1""",
    "import_warnings": f"""
WITH s AS ({_plain(IMPORT, 'part')}), k AS (SELECT *, DatabaseName || '.' || SchemaName || '.' || ObjectName || '.' || ColumnName AS key, row_number() OVER (PARTITION BY SchemaName, ObjectName, ColumnName ORDER BY pos) AS r FROM s WHERE trim(DatabaseName) <> '' AND ColumnName IS NOT NULL)
SELECT pos, 'Satır ' || (pos + 2) || ': eksik veritabanı/şema/obje/kolon, atlandı' AS warning FROM s WHERE trim(DatabaseName) = '' OR ColumnName IS NULL UNION ALL SELECT pos, 'Tekrarlanan kolon, ilk kayıt tutuldu: ' || key FROM k WHERE r > 1""",
    "object_profiles": f"SELECT 'DWH.' || SchemaName || '.' || ObjectName AS object_key, arg_max(ObjectDescription, pos) AS description, 'Satır, ay' AS grain, 'Period,DataDate' AS time_columns, arg_max(coalesce(DatasetGroup, ''), pos) AS \"group\" FROM ({_plain(OBJECTS, 'part')}) GROUP BY ALL",
    "vocabulary_checks": f"""
WITH i AS (SELECT p_partkey, trim(CASE WHEN p_partkey % 41 = 40 THEN ' ' ELSE p_name || ' ' || (p_partkey % 190) END) AS term FROM part)
SELECT CAST(p_partkey + 1 AS INT) AS row, term, CAST(CASE WHEN p_partkey % 53 = 52 THEN 1 ELSE 2 END AS BIGINT) AS n_equivalents,
  CASE WHEN term = '' THEN 'vocabulary_term_empty' WHEN p_partkey % 97 = 96 THEN 'vocabulary_value_too_long' WHEN row_number() OVER (PARTITION BY {Q.fold('term')} ORDER BY p_partkey) > 1 THEN 'vocabulary_term_duplicate' END AS failure FROM i""",
    "vocabulary_refusal": f"""
WITH i AS (SELECT p_partkey, trim(CASE WHEN p_partkey % 41 = 40 THEN ' ' ELSE p_name || ' ' || (p_partkey % 190) END) AS term FROM part),
f AS (SELECT CAST(p_partkey + 1 AS INT) AS row, CASE WHEN term = '' THEN 'vocabulary_term_empty' WHEN p_partkey % 97 = 96 THEN 'vocabulary_value_too_long' WHEN row_number() OVER (PARTITION BY {Q.fold('term')} ORDER BY p_partkey) > 1 THEN 'vocabulary_term_duplicate' END AS failure FROM i)
SELECT min(row) FILTER (failure IS NOT NULL) AS row, CASE WHEN count(*) > 5000 THEN 'vocabulary_too_many_items' ELSE arg_min(failure, row) FILTER (failure IS NOT NULL) END AS failure FROM f""",
    "stopword_checks": f"""
WITH w AS (SELECT CAST(p_partkey + 1 AS INT) AS row, CASE WHEN p_partkey % 11 = 0 THEN '' WHEN p_partkey % 13 = 0 THEN p_name ELSE upper(split_part(p_name, ' ', 1)) || (p_partkey % 30) END AS word, p_type AS "group" FROM part)
SELECT row, word, "group", CASE WHEN contains(word, ' ') THEN 'vocabulary_stopword_not_single_word' END AS failure FROM (SELECT *, row_number() OVER (PARTITION BY {Q.fold('word')} ORDER BY row) AS r FROM w WHERE word <> '') WHERE r = 1""",
    "word_list": "SELECT CAST(p_partkey AS INT) AS row, p_name AS term, p_type || '+' || p_brand AS equivalents, CASE WHEN p_size > 25 THEN 'ürün' ELSE '' END AS domain, '' AS note FROM part",
    "source_definitions": f"""
SELECT row_number() OVER (ORDER BY lower(database), lower(schema), lower(name), lower(description), database, schema, name, description) - 1 AS pos, schema, name, description
FROM (SELECT trim(database) AS database, schema, name, description FROM ({_plain(SOURCE_TABLES, 'supplier', 'nation')}) WHERE name <> 'null')""",
    "source_probe": "SELECT (SELECT count(DISTINCT c_mktsegment || '|' || c_name) FROM customer JOIN orders ON o_custkey = c_custkey) AS tables, (SELECT count(DISTINCT p_type || '|' || p_brand || '|' || p_name) FROM part) AS columns, (SELECT max(o_orderdate) FROM orders JOIN customer ON o_custkey = c_custkey) AS last_change",
    "source_catalog": "SELECT p_type AS schema, p_brand AS name, CASE WHEN p_brand NOT LIKE '%3' THEN CAST(count(DISTINCT p_name) AS INT) END AS n_columns, CASE WHEN p_brand NOT LIKE '%3' THEN array_to_string(list_sort(list(DISTINCT p_name)), ',') END AS columns FROM part GROUP BY p_type, p_brand",
    "located_tables": f"""
WITH s AS (SELECT DISTINCT schema, name FROM ({_plain(SPELLED, 'supplier', 'nation')})), p AS (SELECT DISTINCT schema, name FROM ({_plain(PLACES, 'supplier', 'nation')})),
a AS (SELECT s.*, x.schema AS to_schema FROM s LEFT JOIN (SELECT DISTINCT schema FROM p) x ON lower(trim(s.schema)) = lower(x.schema)),
b AS (SELECT a.*, p.name AS to_name, row_number() OVER (PARTITION BY a.schema, a.name ORDER BY CASE WHEN a.name = p.name THEN 0 WHEN lower(a.name) = lower(p.name) THEN 1 ELSE 2 END) AS r
  FROM a LEFT JOIN p ON p.schema = to_schema AND (lower(a.name) = lower(p.name) OR (damerau_levenshtein(lower(a.name), lower(p.name)) = 1 AND NOT regexp_matches(a.name, '[0-9]')))),
f AS (SELECT schema, name, CASE WHEN to_name IS NOT NULL THEN to_schema END AS to_schema, to_name FROM b WHERE r = 1),
e AS (SELECT f.schema, f.name, min(p.schema) AS s2, min(p.name) AS n2 FROM f JOIN p ON lower(p.name) = lower(f.name) WHERE f.to_name IS NULL GROUP BY ALL HAVING count(*) = 1)
SELECT f.schema, f.name, coalesce(f.to_schema, CASE WHEN t.name IS NULL THEN s2 END) AS to_schema, coalesce(f.to_name, CASE WHEN t.name IS NULL THEN n2 END) AS to_name
FROM f LEFT JOIN e USING (schema, name) LEFT JOIN (SELECT DISTINCT to_schema AS schema, to_name AS name FROM f WHERE to_name IS NOT NULL) t ON t.schema = s2 AND t.name = n2""",
    "curated_texts": f"""
WITH {_TEXT_ROWS}
SELECT pos, CASE WHEN p_size % 4 = 0 THEN said ELSE clean END AS description, CASE WHEN p_size % 7 = 0 THEN 'Kalem kodu' ELSE 'Müşteri sınıfı' END AS summary,
  CASE WHEN p_size % 5 > 0 THEN 'şube, branch' || CASE WHEN p_size % 4 > 0 AND k = 3 THEN ', faiz oranı' || ', kredi' WHEN p_size % 4 > 0 AND k = 7 THEN ', leasing, finansal kiralama' ELSE '' END END AS synonyms,
  CAST(CASE WHEN p_size % 4 = 0 THEN 0 WHEN k IN (0, 1, 2, 3, 6) THEN 1 ELSE 0 END AS BIGINT) AS n_removed, p_size % 4 = 1 AND said <> clean AS from_source FROM r""",
    "curation_changes": f"WITH {_TEXT_ROWS} SELECT 'description' AS field, count(*) AS n FROM r WHERE p_size % 4 > 0 AND said <> clean HAVING count(*) > 0 UNION ALL SELECT 'summary', count(*) FROM r",
    "mechanical_checks": f"""
WITH {_TEXT_ROWS}, o AS (SELECT p_brand, min(p_size) AS s FROM part GROUP BY p_brand), n AS (
  SELECT 'belirsizlik' AS "check", (SELECT count(*) FROM r) + (SELECT count(*) FROM o WHERE s % 2 = 0) - (SELECT count(*) FROM r WHERE p_size % 7 > 0 AND p_size % 5 = 0 AND NOT doubtful) AS n
  UNION ALL SELECT 'bos_aciklama', count(*) FROM r WHERE said = '' UNION ALL SELECT 'aciklama_es_anlamli', count(*) FROM r WHERE said <> '' AND p_size % 5 = 0
  UNION ALL SELECT 'olmayan_anahtar_kolon', count(*) FROM o WHERE s % 3 = 0 UNION ALL SELECT 'olmayan_zaman_kolonu', 0 UNION ALL SELECT 'haric_kolon', count(*) FROM r WHERE pos % 101 = 0)
SELECT "check", CAST(n AS BIGINT) AS count, CAST(least(n, 5) AS BIGINT) AS n_examples FROM n""",
    "score_cards": f"""
WITH r AS ({_plain(CARDS, 'part')}), s AS (SELECT *, n_right + n_minor + n_wrong AS n FROM r), t AS (
  SELECT *, CAST(round_even(greatest(0.0, 100 * (CASE WHEN n > 0 THEN 1 - CAST(n_wrong AS DOUBLE) / n ELSE 1 END) * (1 - CAST(failures AS DOUBLE) / calls) - 10 * failed), 0) AS INT) AS score, CAST(n_wrong AS DOUBLE) / nullif(n, 0) AS p FROM s
), u AS (SELECT *, (p + 1.9208 / n) / (1 + 3.8416 / n) AS centre, 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4.0 * n * n)) / (1 + 3.8416 / n) AS half, greatest(0, score + 10 * failed - 10 * failed_now) AS again FROM t)
SELECT p_brand, score, CASE WHEN score < 75 THEN 'reddedilmeli' WHEN failed > 0 THEN 'incelenmeli' WHEN score >= 90 AND (n > 0 OR scope = 0) THEN 'onaylanabilir' ELSE 'incelenmeli' END AS verdict,
  round_even(greatest(0.0, coalesce(centre - half, 0)), 3) AS wrong_low, CASE WHEN n > 0 THEN round_even(least(1.0, centre + half), 3) ELSE 0 END AS wrong_high, again AS score_again,
  CASE WHEN again < 75 THEN 'reddedilmeli' WHEN failed_now > 0 THEN 'incelenmeli' WHEN again >= 90 AND (n > 0 OR scope = 0) THEN 'onaylanabilir' ELSE 'incelenmeli' END AS verdict_again FROM u""",
    "judge_shares": """
SELECT p_brand, count(CASE WHEN p_size % 4 = 0 THEN 1 END) AS n_right, count(CASE WHEN p_size % 4 = 1 THEN 1 END) AS n_minor, count(CASE WHEN p_size % 4 = 2 THEN 1 END) AS n_wrong, count(CASE WHEN p_size % 4 = 3 THEN 1 END) AS failures,
  coalesce(round(CAST(count(CASE WHEN p_size % 4 = 2 THEN 1 END) AS DOUBLE) / nullif(count(CASE WHEN p_size % 4 < 3 THEN 1 END), 0), 6), 0) AS wrong_share FROM part GROUP BY p_brand""",
    "aligned_objects": f"""
SELECT object_key, CASE WHEN KeyColumns = 'CustomerId' THEN 'CustomerId' ELSE 'AccountNumber' END || CASE WHEN Grain LIKE '%Veri tarihi' AND TimeColumns = 'datadate' THEN ', DataDate' WHEN Grain LIKE '%Periyot%' THEN CASE WHEN TimeColumns = 'Period' THEN ', Period' ELSE ', DataDate' END ELSE '' END AS KeyColumns,
  CASE WHEN TimeColumns = 'datadate' THEN 'DataDate' ELSE 'Period' END AS TimeColumns, CASE WHEN BusinessDomain = 'Kart ' THEN 'Kart ve Harcama' ELSE 'Risk' END AS BusinessDomain FROM ({_plain(ALIGN, 'part')})""",
    "column_lineage": """
SELECT * FROM (VALUES
  ('EDWDM.SAL.vOffer', 'OfferId', 'duz', 'o.OfferNk AS OfferId | S.OfferId AS OfferNk | Kaynak: edwstg.crm.offer.offerid', 'WHERE o.Written >= ''2025-01-01'''),
  ('EDWDM.SAL.vOffer', 'Tries', 'mantik', 'ISNULL(S.Tries, 0) AS Tries | Kaynak: edwstg.crm.offer.tries', 'WHERE o.Written >= ''2025-01-01'''),
  ('EDWDM.SAL.vOffer', 'Staff', 'mantik', 'CASE WHEN K.Id IS NOT NULL THEN 1 ELSE 0 END AS Staff | LEFT JOIN EDWUTIL.DTG.KeyPerson K ON o.PersonId = K.Id', 'WHERE o.Written >= ''2025-01-01'''),
  ('EDWDM.SAL.vPlain', 'OfferId', 'duz', 'o.OfferNk AS OfferId | S.OfferId AS OfferNk | Kaynak: edwstg.crm.offer.offerid', ''),
  ('EDWDM.SAL.rpt_Odd', 'Level', 'bilinmiyor', 'EXEC other @Level = 3', ''), ('EDWDM.SAL.none', 'x', 'bilinmiyor', '', '')
) AS v(object_key, column_name, kind, steps, scope)""",
    "lineage_writes": "SELECT 'edwlry.sal.ins_offer' AS module, 'edwlry.sal.offer' AS \"table\", 'OfferNk,Tries' AS columns, 'edwstg.crm.offer' AS sources",
    "lineage_scope": "SELECT * FROM (VALUES ('EDWDM.SAL.vOffer', 'OfferId', NULL), ('EDWDM.SAL.vOffer', 'Tries', NULL), ('EDWDM.SAL.vOffer', 'Staff', NULL), ('EDWDM.SAL.vPlain', 'OfferId', NULL), ('EDWDM.SAL.rpt_Odd', 'Level', NULL), ('EDWDM.SAL.none', 'x', NULL)) AS v(object_key, column_name, reason)",
    "catalog_lines": f"""
WITH {_C}, g AS (SELECT object_key, arg_max(dataset_group, {{'n': n, 'f': -f}}) AS grp FROM (SELECT object_key, dataset_group, count(*) AS n, min(id) AS f FROM c WHERE dataset_group <> '' GROUP BY ALL) GROUP BY object_key),
o AS (SELECT object_key, string_agg(column_name, ', ' ORDER BY id) AS names, max(CASE WHEN id % 50 = 0 THEN 1 ELSE 0 END) AS told, 'T' || row_number() OVER (ORDER BY object_key) AS id FROM c GROUP BY object_key)
SELECT id, object_key, sha256(id || ' | ' || object_key || ' | ' || coalesce(grp, '-') || CASE WHEN told = 1 THEN ' | Tutar tablosu | Satır: müşteri | Zaman: Period' ELSE ' | Kolonlar: ' || names END) AS line_sha256 FROM o LEFT JOIN g USING (object_key)""",
    "name_spread": f"WITH {_C} SELECT column_name, count(DISTINCT object_key) AS tables FROM c GROUP BY column_name HAVING count(DISTINCT object_key) >= 4 ORDER BY tables DESC, column_name LIMIT 8",
    "main_groups": f"""
WITH {_C}, n AS (SELECT object_key, dataset_group, row_number() OVER (PARTITION BY object_key ORDER BY count(*) DESC, min(id)) AS r FROM c WHERE dataset_group <> '' GROUP BY object_key, dataset_group)
SELECT o.object_key, coalesce(dataset_group, '-') AS "group" FROM (SELECT DISTINCT object_key FROM c) o LEFT JOIN n ON n.object_key = o.object_key AND r = 1""",
    "table_material": f"""
WITH {_C}, a AS (SELECT DISTINCT object_key FROM c WHERE id % 5 = 0), r AS (
  SELECT c.object_key, id, CASE WHEN id % 5 = 0 THEN (id % 7) / 7.0 ELSE 0 END AS rel, count(*) OVER (PARTITION BY c.object_key) AS size,
    row_number() OVER (PARTITION BY c.object_key ORDER BY CASE WHEN id % 5 = 0 THEN (id % 7) / 7.0 ELSE 0 END DESC, CASE WHEN list_contains([{", ".join(map(Q.quoted, analyst.STRUCTURAL))}], {Q.fold('column_name')}) THEN 0 ELSE 1 END, id) AS place FROM c JOIN a USING (object_key))
SELECT object_key, CAST(place AS INT) AS place, id, CASE WHEN size > 6 AND place > 6 THEN 'name' WHEN place <= 2 AND rel > 0 THEN 'detail' ELSE 'brief' END AS part FROM r""",
    "look_alikes": f"""
WITH {_C}, a AS (SELECT CAST(id % 3 AS INT) AS query, object_key, id, {_HITS} AS worth FROM c), p AS (SELECT * FROM a WHERE worth > 0 AND object_key NOT LIKE '%Brand1'),
o AS (SELECT query, id FROM (SELECT *, row_number() OVER (PARTITION BY query, object_key ORDER BY worth DESC, id) AS r FROM p WHERE object_key LIKE '%Brand2') WHERE r <= 2),
s AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY worth DESC, id) AS r FROM p WHERE (query, id) NOT IN (SELECT (query, id) FROM o))
SELECT query, id, 'table' AS part FROM o UNION ALL SELECT query, id, 'column' FROM s WHERE r <= 20""",
    "narrow_tables": f"WITH {_C} SELECT object_key FROM c GROUP BY object_key HAVING min(id) % 3 < 2",
    "shortlists": f"""
WITH {_KNOWN}, q AS (SELECT n_nationkey AS query FROM nation),
e AS (
  SELECT query, 'candidate' AS part, i AS pos, trim(CASE i % 4 WHEN 0 THEN 'T' || (1 + (query + i) % 40) WHEN 1 THEN 'vSmallBrand' || (1 + (query * i) % 30) WHEN 2 THEN 'T9999' ELSE 'DWH.SMALL.vSmallBrand' || (1 + i % 25) END) AS raw FROM q, (SELECT unnest(range(0, 20)) AS i)
  UNION ALL SELECT query, 'confusable', i, 'T' || (1 + (query + i * 4) % 45) FROM q, (SELECT unnest(range(0, 6)) AS i)
), r AS (SELECT e.*, (SELECT min(object_key) FROM tabs WHERE id = raw OR object_key = raw OR (bare = {Q.fold('raw')} AND (SELECT count(*) FROM tabs b WHERE b.bare = {Q.fold('e.raw')}) = 1)) AS object_key FROM e),
f AS (SELECT query, part, object_key, CAST(row_number() OVER (PARTITION BY query, part ORDER BY min(pos)) AS INT) AS place FROM r WHERE object_key IS NOT NULL GROUP BY query, part, object_key),
k AS (SELECT * FROM f WHERE place <= CASE WHEN part = 'candidate' THEN 14 ELSE 6 END)
SELECT query, part, place, object_key FROM k WHERE part = 'candidate' OR (query, object_key) NOT IN (SELECT (query, object_key) FROM k WHERE part = 'candidate')
UNION ALL SELECT query, 'unknown', CAST(count(*) AS INT), NULL FROM r WHERE object_key IS NULL GROUP BY query""",
    "checked_texts": f"""
WITH {_C}, x AS (SELECT EXISTS (SELECT 1 FROM c WHERE object_key = 'DWH.SMALL.vSmallBrand1') AS there)
SELECT p_partkey AS id, CASE WHEN there THEN 'DWH.SMALL.vSmallBrand1 tablosu var. ' ELSE '' END || 'Hepsi bu.' AS text, CAST(CASE WHEN there THEN 0 ELSE 1 END + CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 0 END AS BIGINT) AS dropped FROM part, x""",
    "resolved_columns": f"WITH {_C} SELECT id AS of, CASE WHEN id % 4 < 3 THEN min(id) OVER (PARTITION BY object_key, column_name) END AS id FROM c",
    "validated_hits": "SELECT quality, count(*) AS n, (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')) AS dropped FROM labels WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en') GROUP BY quality",
    "stored_answers": """
WITH a AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate FROM orders WHERE o_orderkey % 2 = 0 QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate DESC, o_orderkey DESC) = 1 ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 200),
b AS (SELECT * FROM a UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate FROM orders WHERE o_orderkey % 2 = 1)
SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate DESC, o_orderkey DESC) = 1 ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 200""",
    "stored_digests": "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_size + 1000 ELSE p_size END AS digest FROM part WHERE p_partkey % 5 <> 0",
    "stored_vocabulary": "SELECT n_name, 2 AS revision FROM nation WHERE n_name LIKE '%1%'",
    "version_life": "SELECT CAST(2 AS BIGINT) AS versions, CAST(5 AS BIGINT) AS active_rows, CAST(1 AS BIGINT) AS pruned, 'dictionary' AS stale",
    "retain_by_owner": "SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 5",
    "dictionary_digest": """SELECT substr(sha256('[' || string_agg('{"p_brand": "' || p_brand || '", "p_name": "' || p_name || '", "p_type": "' || p_type || '"}', ', ' ORDER BY p_partkey) || ']'), 1, 12) AS digest FROM part""",
    "name_hashes": f"""
WITH h AS (SELECT p_partkey, CAST({_FNV.format(e="(p_name || ' ışĞ')")} AS BIGINT) AS hash, CAST({_FNV.format(e='p_name')} AS BIGINT) AS s FROM part)
SELECT p_partkey, hash, xor(CAST((xor(s, s >> 15)::HUGEINT * 2246822507) % 4294967296 AS BIGINT), CAST((xor(s, s >> 13)::HUGEINT * 3266489909) % 4294967296 AS BIGINT)) AS next FROM h""",
    "galaxy_clusters": f"""
WITH g AS (SELECT p_brand AS "group", count(*) AS n, min(p_partkey) AS f FROM part GROUP BY p_brand), o AS (SELECT *, CAST(row_number() OVER (ORDER BY n DESC, f) - 1 AS INT) AS place, count(*) OVER () AS k FROM g)
SELECT "group", place, n, round(cos(place * (pi() * (3 - sqrt(5)))) * (0.1 + 0.82 * sqrt((place + 0.5) / k)), 6) AS x, round(sin(place * (pi() * (3 - sqrt(5)))) * (0.1 + 0.82 * sqrt((place + 0.5) / k)), 6) AS y, CAST({_FNV.format(e='"group"')} AS BIGINT) % 360 AS hue FROM o""",
    "tree_order": """
WITH RECURSIVE s AS (SELECT conv_id AS trace, turn AS seq, CASE WHEN turn = 0 THEN NULL WHEN turn % 3 = 0 THEN 99 ELSE (turn - 1) // 2 END AS parent, length(text) AS start_ms FROM conversations),
k AS (SELECT s.trace, s.seq, s.start_ms, p.seq AS parent FROM s LEFT JOIN s p ON p.trace = s.trace AND p.seq = s.parent),
w AS (SELECT trace, seq, 0 AS depth, lpad(CAST(start_ms AS VARCHAR), 12, '0') || lpad(CAST(seq AS VARCHAR), 8, '0') AS path FROM k WHERE parent IS NULL
  UNION ALL SELECT k.trace, k.seq, w.depth + 1, w.path || lpad(CAST(k.start_ms AS VARCHAR), 12, '0') || lpad(CAST(k.seq AS VARCHAR), 8, '0') FROM w JOIN k ON k.trace = w.trace AND k.parent = w.seq)
SELECT * FROM w""",
    "palette": "SELECT p_partkey, CAST(CASE WHEN contains(p_name, 'red') THEN 3 ELSE 1 END + CASE WHEN starts_with(p_name, 'red') THEN 2 ELSE 0 END + CASE WHEN contains(p_name, 'ri') THEN 3 ELSE 1 END + CASE WHEN starts_with(p_name, 'ri') THEN 2 ELSE 0 END AS INT) AS score FROM part WHERE contains(lower(p_name || ' ' || p_type), 'red') AND contains(lower(p_name || ' ' || p_type), 'ri') ORDER BY score DESC, p_partkey LIMIT 60",
    "exact_tables": f"""
WITH {_C}, t AS (SELECT DISTINCT object_key, translate(lower(object_key), 'ı', 'i') AS low FROM c), w AS (SELECT DISTINCT CASE WHEN length(object_key) % 3 = 0 THEN upper(object_key) WHEN length(object_key) % 3 = 1 THEN ' ' || split_part(object_key, '.', 3) || ' ' ELSE split_part(object_key, '.', 1) END AS wanted FROM t)
SELECT wanted, (SELECT CASE WHEN count(*) = 1 THEN min(object_key) END FROM t WHERE low = replace(lower(replace(trim(wanted), 'I', 'ı')), 'ı', 'i') OR ends_with(low, '.' || replace(lower(replace(trim(wanted), 'I', 'ı')), 'ı', 'i'))) AS object_key FROM w""",
    "replayed_events": "SELECT e.event_id, e.user_id FROM events e JOIN (SELECT user_id, max(event_id) AS last FROM events WHERE event_type = 'signup' GROUP BY user_id) s ON s.user_id = e.user_id AND e.event_id > s.last",
}
