"""A data dictionary made of the parts, with a vocabulary and questions, for the search over columns.

A part is a column of a table of its brand and type; its name, type and size give the column's name, synonyms and
description. The 25 nations give the questions. The SQL is read alike by Spark and by the SQL for comparison.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarrymap.session import table

_FIRST, _SECOND = "split_part(p_name, ' ', 1)", "split_part(p_name, ' ', 2)"
_CAPITALS = f"upper(substr({_FIRST}, 1, 1)) || substr({_FIRST}, 2) || upper(substr({_SECOND}, 1, 1)) || substr({_SECOND}, 2)"
COLUMNS = f"""
SELECT p_partkey AS id, 'DWH.' || p_type || '.v' || upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) || 'Brand' || substr(p_brand, 7) AS object_key,
       'v' || upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) || 'Brand' || substr(p_brand, 7) AS object_name,
       CASE WHEN p_partkey % 23 = 0 THEN 'DataDate' WHEN p_partkey % 29 = 0 THEN 'Period' WHEN p_partkey % 31 = 0 THEN 'CustomerId' WHEN p_partkey % 37 = 0 THEN 'ProductTypeName' WHEN p_partkey % 41 = 0 THEN 'CardProductName'
            ELSE {_CAPITALS} || CASE p_size % 4 WHEN 0 THEN 'Rate' WHEN 1 THEN 'Count' WHEN 2 THEN 'Amount' ELSE '' END END AS column_name,
       p_name || CASE WHEN p_size % 2 = 0 THEN ' (' || lower(p_type) || ', ' || substr(p_brand, 7) || ')' ELSE '' END || ', ' || CASE p_size % 5 WHEN 0 THEN 'ürün tutarı' WHEN 1 THEN 'müşteri adedi' ELSE lower(p_type) || ' ' || {_FIRST} END
         || CASE WHEN p_size % 3 = 0 THEN ', ' || {_SECOND} ELSE '' END || '.' AS synonyms,
       p_name || ' ' || lower(p_type) || CASE p_size % 6 WHEN 0 THEN ' oranı, kart bazlı değil' WHEN 1 THEN ' adedi' WHEN 2 THEN ' bakiyesi; ' || {_SECOND} || ' değil' WHEN 3 THEN ' müşteri bazında' ELSE '' END AS description,
       CASE WHEN p_size % 7 > 0 THEN 'Grup ' || CAST(p_size % 3 AS «text») END AS dataset_group
FROM {{part}}"""
#: What tables hold, for the topic index.
PROFILES = """
SELECT DISTINCT 'DWH.' || p_type || '.v' || upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) || 'Brand' || substr(p_brand, 7) AS object_key,
       lower(p_type) || ' ürünleri, marka ' || substr(p_brand, 7) || '; satır: müşteri başına ay' AS profile FROM {part}"""
QUESTIONS = """
SELECT n_nationkey AS query, CASE n_nationkey % 5 WHEN 0 THEN 'aylık ' || p_name || ' oranı müşteri bazında' WHEN 1 THEN 'Günlük ' || p_name || ' adedi ' || lower(p_type) || ' listesi' WHEN 2 THEN p_name || ' kırılımlı olarak (kırmızı halka, ' || split_part(p_name, ' ', 2) || ' vb.) tutar'
       WHEN 3 THEN upper(substr(p_name, 1, 1)) || replace(substr(p_name, 2), ' ', '_') || 'Rate halka 2024' ELSE p_name || ' değil müşteri kartı zxqv' END AS text
FROM {nation} JOIN {part} ON p_partkey = n_nationkey * 7 + 3"""
#: (term, equivalents, domain, note), in order.
VOCABULARY = [
    ("ring", ["halka", "yüzük", "red ring"], "ürün", ""),
    ("red ring", ["kırmızı halka", "crimson band"], "ürün", "Kapsam: yalnız yurt içi."),
    ("widget", ["parça", "gadget"], "ürün", ""),
    ("small", ["küçük", "mini"], "", ""),
    ("blue bolt", ["mavi cıvata", "bolt"], "ürün", "bilgi notu"),
    ("tutar", ["amount", "bakiye"], "Finansal", ""),
    ("müşteri", ["customer", "kişi"], "", ""),
    ("kart", ["card", "kredi kartı"], "", "KAPSAM: fiziki kart"),
]


def _sql(sql: str, text: str) -> str:
    return sql.replace("«text»", text)


def columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, object_key, object_name, column_name, synonyms, description, dataset_group."""
    return spark.sql(_sql(COLUMNS, "STRING"), part=table(spark, sf_dir, "part"))


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(PROFILES, part=table(spark, sf_dir, "part"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query, text."""
    return spark.sql(QUESTIONS, part=table(spark, sf_dir, "part"), nation=table(spark, sf_dir, "nation"))


def vocabulary(spark: SparkSession) -> DataFrame:
    """gid, term, equivalents, domain, note."""
    rows = [(i, *v) for i, v in enumerate(VOCABULARY)]
    return spark.createDataFrame(rows, "gid int, term string, equivalents array<string>, domain string, note string")


def plain(sql: str) -> str:
    """The mapping's SQL over bare tables."""
    return _sql(sql, "VARCHAR").replace("{part}", "part").replace("{nation}", "nation")
