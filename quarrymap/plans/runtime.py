"""Queries over sources, limits and repaired replies, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quarrymap.functions.descriptions import valid_description
from quarrymap.functions.replies import salvaged
from quarrymap.operators.merge import digests, field_changes, merge
from quarrymap.operators.records import first_of_key
from quarrymap.session import shared_folder, table
from quarrymap.sources.workbook import records, read_workbooks, write_workbook
from quarrymap.streaming.rate import limited

LIMIT, SECONDS = 5, 3 * 86400
#: A reply with two nested values, by order.
REPLY = """'{"key":' || o_orderkey || ',"parts":[{"p":"' || o_orderpriority || '"},{"q":[' || o_custkey || '],"r":"}' || o_orderstatus || '"}],"x":1}'"""


def rate_limited(spark, sf_dir):
    """Which events a limit of five in three days for each user lets through."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return limited(events, "user_id", "ts", "event_id", LIMIT, SECONDS).select("event_id", "user_id", "allowed")


def reply_salvage(spark, sf_dir):
    """Replies cut at a place that the key gives, repaired."""
    made = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(REPLY).alias("whole"))
    return made.select("o_orderkey", salvaged(F.expr("substr(whole, 1, 5 + o_orderkey % 90)")).alias("reply"))


def workbook_scan(spark, sf_dir):
    """Regions and nations written to a workbook and read back as records."""
    path = f"{shared_folder(spark)}/workbook-{uuid.uuid4().hex}.xlsx"
    write_workbook({name: table(spark, sf_dir, name) for name in ("region", "nation")}, path)
    found = records(read_workbooks(spark, path)).where("sheet = 'nation'")
    value = lambda name: F.col("record").getItem(name)
    return found.select(value("n_nationkey").cast("int").alias("n_nationkey"), value("n_name").alias("n_name"), value("n_regionkey").cast("int").alias("n_regionkey"))


def dictionary_columns(spark, sf_dir):
    """The first event of every user and type, numbered in order of appearance."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.col("value").alias("v"))
    return first_of_key(events, ["user_id", "event_type"], "event_id").select(F.col("_id").alias("id"), "user_id", "event_type", "event_id")


#: A curated snapshot of the parts: some texts are empty, some the source's, some cleaned, some written by hand.
SNAPSHOT = """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN p_name ELSE 'old ' || p_name END AS p_name,
  CASE WHEN p_partkey % 5 <> 0 AND p_partkey % 3 = 0 THEN 'kaynak' ELSE '' END AS p_name_origin, CASE WHEN p_partkey % 4 = 0 THEN p_name END AS p_name_from,
  CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE p_type END AS p_type FROM {part} WHERE p_partkey % 7 <> 0"""


def _merged(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    return merge(spark.sql(SNAPSHOT, part=part), part.where("p_partkey % 11 <> 0"), ["p_partkey"], ["p_name", "p_type"], part.where("p_partkey % 2 = 0"))


def reconciled_parts(spark, sf_dir):
    """The snapshot of the parts after a merge with its source."""
    return _merged(spark, sf_dir)


def reconciled_changes(spark, sf_dir):
    """The fields that the merge changed."""
    return field_changes(_merged(spark, sf_dir), ["p_partkey"], ["p_name", "p_type"])


def changed_digests(spark, sf_dir):
    """Orders whose lines say something else once one kind of line is returned."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    now = lines.withColumn("l_returnflag", F.when(F.expr("l_linestatus = 'O' AND l_linenumber = 2"), "R").otherwise(F.col("l_returnflag")))
    fields = ["l_linenumber", "l_returnflag", "l_linestatus"]
    old, new = digests(lines, ["l_orderkey"], fields), digests(now, ["l_orderkey"], fields).withColumnRenamed("digest", "now")
    return old.join(new, "l_orderkey").where("digest <> now").select("l_orderkey")


#: Descriptions of parts, and the facts that they may name.
DESCRIBED = "CASE p_partkey % 3 WHEN 0 THEN p_name || ' ' || p_size || '.' WHEN 1 THEN p_name || ', T' || p_size || '.' ELSE p_name END"
FACTS = "CASE WHEN p_partkey % 2 = 0 THEN p_size || ' ' || p_name ELSE p_name END"


def valid_descriptions(spark, sf_dir):
    """Which descriptions pass the mechanical checks."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.expr(DESCRIBED).alias("t"), F.expr(FACTS).alias("f"))
    return part.select("p_partkey", valid_description(F.col("t"), F.col("f"), 40).alias("valid"))


QUERIES = {f.__name__: f for f in (rate_limited, reply_salvage, workbook_scan, dictionary_columns, reconciled_parts, reconciled_changes, changed_digests, valid_descriptions)}
_MERGED = f"""
WITH p AS ({SNAPSHOT.format(part='part')}), s AS (SELECT p_partkey, p_name, p_type FROM part WHERE p_partkey % 11 <> 0),
j AS (
  SELECT coalesce(p.p_partkey, s.p_partkey) AS k, p.p_partkey IS NULL AS is_new, s.p_partkey IS NULL AS is_gone, coalesce(p.p_name, '') AS n0, coalesce(p_name_origin, '') AS o0,
         coalesce(p_name_from, '') AS f0, coalesce(p.p_type, '') AS t0, coalesce(s.p_name, '') AS n1, coalesce(s.p_type, '') AS t1
  FROM p FULL OUTER JOIN s ON p.p_partkey = s.p_partkey
), m AS (
  SELECT *, n0 = '' OR (o0 = 'kaynak' AND n1 <> '' AND (f0 = '' OR n1 <> f0)) AS n_follows FROM j
), r AS (
  SELECT k AS p_partkey, is_new, is_gone, CASE WHEN n_follows THEN n1 ELSE n0 END AS p_name,
         CASE WHEN n_follows THEN CASE WHEN n1 <> '' THEN 'kaynak' ELSE '' END WHEN o0 = '' THEN 'onceki' ELSE o0 END AS p_name_origin, n0 AS p_name_old,
         CASE WHEN t0 = '' THEN t1 ELSE t0 END AS p_type, CASE WHEN t0 <> '' THEN 'onceki' WHEN t1 <> '' THEN 'kaynak' ELSE '' END AS p_type_origin, t0 AS p_type_old
  FROM m
), merged AS (
  SELECT * EXCLUDE (is_new, is_gone), CASE WHEN is_new THEN 'added' WHEN is_gone AND p_partkey % 2 = 0 THEN 'kept' WHEN is_gone THEN 'removed' WHEN p_name <> p_name_old OR p_type <> p_type_old THEN 'changed' ELSE 'same' END AS kind FROM r
)"""
ORACLES = {
    "rate_limited": f"""
WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
walk AS (
  SELECT event_id, user_id, r, true AS allowed, [us] AS held FROM e WHERE r = 1
  UNION ALL
  SELECT event_id, user_id, r, len(kept) < {LIMIT}, CASE WHEN len(kept) < {LIMIT} THEN list_append(kept, us) ELSE kept END
  FROM (SELECT e.*, list_filter(held, lambda x: e.us - x < {SECONDS * 1_000_000}) AS kept FROM walk JOIN e ON e.user_id = walk.user_id AND e.r = walk.r + 1)
)
SELECT event_id, user_id, allowed FROM walk""",
    "reply_salvage": f"""
WITH w AS (SELECT o_orderkey, {REPLY} AS whole, 5 + o_orderkey % 90 AS n FROM orders),
p AS (SELECT *, strpos(whole, '}},') AS a, strpos(whole, '],"r"') AS b, strpos(whole, '"}}],"x"') + 1 AS c FROM w)
SELECT o_orderkey, CASE WHEN n >= length(whole) OR n < a THEN NULL WHEN n < b THEN substr(whole, 1, a) || ']}}' WHEN n < c THEN substr(whole, 1, b) || '}}]}}'
       WHEN n < c + 1 THEN substr(whole, 1, c) || ']}}' ELSE substr(whole, 1, c + 1) || '}}' END AS reply FROM p""",
    "workbook_scan": "SELECT n_nationkey, n_name, n_regionkey FROM nation",
    "dictionary_columns": """
SELECT row_number() OVER (ORDER BY event_id) - 1 AS id, user_id, event_type, event_id FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS r FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL) WHERE r = 1""",
    "reconciled_parts": _MERGED + " SELECT * FROM merged",
    "reconciled_changes": _MERGED + """
SELECT p_partkey, 'p_name' AS field, p_name_old AS old, p_name AS new, p_name_origin AS origin FROM merged WHERE kind = 'changed' AND p_name <> p_name_old
UNION ALL SELECT p_partkey, 'p_type', p_type_old, p_type, p_type_origin FROM merged WHERE kind = 'changed' AND p_type <> p_type_old""",
    "changed_digests": "SELECT DISTINCT l_orderkey FROM lineitem WHERE l_linestatus = 'O' AND l_linenumber = 2 AND l_returnflag <> 'R'",
    "valid_descriptions": rf"""
WITH x AS (SELECT p_partkey, {DESCRIBED} AS t, {FACTS} AS f FROM part)
SELECT p_partkey, length(t) <= 40 AND ends_with(t, '.') AND NOT regexp_matches(t, '\bT\d+\b')
       AND len(list_filter(regexp_extract_all(t, '\d+(?:[.,]\d+)?'), lambda n: NOT list_contains(regexp_extract_all(f, '\d+(?:[.,]\d+)?'), n))) = 0 AS valid FROM x""",
}
