"""Text, retrieval and ranking queries over documents, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymap.functions import text as X
from quarrymap.operators import bm25, names
from quarrymap.plans import sqltext as Q
from quarrymap.session import bounded, checkpointed, shared_folder, table

WORDS = Q.words("%s")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as columns of a dictionary: the first line is the name, the rest the description, the source the object."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.coalesce("text", F.lit("")).alias("text"))
    first = F.substring_index("text", "\n", 1)
    return docs.select("doc_id", "source", "lang", X.words(first).alias("name"), X.words(F.substr("text", F.length(first) + 2)).alias("description"))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query, term, weight): the distinct words of every benchmark item."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), X.words(F.coalesce("text", F.lit(""))).alias("w"))
    return items.select("query", F.explode(F.array_distinct("w")).alias("term"), F.lit(1.0).alias("weight"))


def fold_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(X.fold(F.col("text")), 256).alias("folded"), F.sha2(X.tr_lower(F.col("text")), 256).alias("lowered"))


def stem_counts(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select(F.explode(X.words(F.col("text"))).alias("w"))
    # Words are counted before they are stemmed, so each distinct word is stemmed once.
    counted = words.groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy(X.stem(F.col("w")).alias("stem")).agg(F.sum("n").alias("n"))


def text_keys(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", X.text_key(F.col("text")).alias("text_key"))


def camel_parts(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(X.split_camel(F.regexp_replace("p_name", " ", "_")), " ").alias("parts"))


def slugs(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", X.slugify(F.concat_ws(" ", "p_name", "p_type")).alias("slug"))


def clipped(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.clip(F.col("text"), 70).alias("clipped"))


def split_terms(spark, sf_dir):
    docs = table(spark, sf_dir, "benchmark")
    return docs.select("item_id", F.size(X.split_terms(F.col("text"))).cast("long").alias("n_terms"))


def normal_forms(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", X.normal_form(F.concat(F.lit(" '"), F.col("s_name"), F.lit(".; "))).alias("normal"))


def tokens(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(X.tokenize(F.col("text")), " ").alias("tokens"))


def bm25_top(spark, sf_dir):
    """The ten best documents for every query; all fields count alike."""
    index = bm25.build(_docs(spark, sf_dir), "doc_id", {"name": 1, "description": 1})
    return bm25.search(index, _asked(spark, sf_dir)).withColumnRenamed("doc", "doc_id")


def bm25_fields(spark, sf_dir):
    """The same with the name counted three times."""
    index = bm25.build(_docs(spark, sf_dir), "doc_id", {"name": 3, "description": 1})
    return bm25.search(index, _asked(spark, sf_dir)).withColumnRenamed("doc", "doc_id")


def index_reloaded(spark, sf_dir):
    """The same search over an index that was written and read again."""
    path = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    bm25.build(_docs(spark, sf_dir), "doc_id", {"name": 3, "description": 1}).save(path)
    return bm25.search(bm25.Index.load(spark, path), _asked(spark, sf_dir)).withColumnRenamed("doc", "doc_id")


def retrieval_metrics(spark, sf_dir):
    """Recall and mean reciprocal rank of benchmark passages against the documents that hold them whole.

    Passages are a stated query set. Long ones meet documents by a run of five of their words, short ones are looked for in
    every document; only documents that are met are read again, whole, to look for the passage.
    """
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), F.col("text").alias("passage")).where("passage is not null and passage <> ''")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text")
    # The first and last word of a passage may be cut, the five after the first are not.
    keyed = items.withColumn("w", X.words(F.col("passage"))).select("query", "passage", F.when(F.size("w") >= 7, F.array_join(F.slice("w", 2, 5), " ")).alias("key"))
    keyed = checkpointed(keyed)
    long, short = keyed.where("key is not null"), keyed.where("key is null")
    runs = docs.select("doc", F.explode(F.array_distinct(_five(X.words(F.col("text"))))).alias("key"))
    met = runs.join(bounded(long.select("query", "key"), 200_000), "key").select("query", "doc").distinct()
    gold = met.join(long, "query").join(docs, "doc").where(F.contains("text", "passage")).select("query", "doc")
    gold = gold.unionByName(docs.join(F.broadcast(short), F.contains("text", "passage")).select("query", "doc")).distinct()  # a stated query set
    ranked = bm25.search(bm25.build(_docs(spark, sf_dir), "doc_id", {"name": 1, "description": 1}), _asked(spark, sf_dir)).select("query", "doc", "rank")
    first = gold.join(ranked, ["query", "doc"], "left").groupBy("query").agg(F.min("rank").alias("rank"))
    at = lambda k: F.round(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)), 4)
    told = first.agg(F.count(F.lit(1)).alias("n"), *(at(k).alias(f"recall_{k}") for k in (1, 3, 5, 10)), F.round(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), 4).alias("mrr"))
    return told.crossJoin(F.broadcast(items.agg(F.count_distinct("query").alias("asked"))))  # one row each


def _five(words):
    return X.once(words, lambda w: X._runs(w, F.size(w), 5))


TYPOS = """SELECT s_suppkey, CASE s_suppkey % 6 WHEN 0 THEN replace(name, 'house', 'hose') WHEN 1 THEN upper(name) WHEN 2 THEN replace(name, 'Ware', 'Waer') WHEN 3 THEN name || '9' WHEN 4 THEN ' ' || name || '.' ELSE name END AS name FROM (
  SELECT s_suppkey, 'Warehouse_' || translate(CAST(s_suppkey AS «text»), '0123456789', 'abcdefghij') || '_' || translate(CAST(s_suppkey AS «text»), '0123456789', 'abcdefghij') || '_Table' AS name FROM {supplier})"""
KNOWN = """SELECT 'Warehouse_' || translate(CAST(s_suppkey AS «text»), '0123456789', 'abcdefghij') || '_' || translate(CAST(s_suppkey AS «text»), '0123456789', 'abcdefghij') || '_Table' AS name FROM {supplier} WHERE s_suppkey % 7 > 0"""


def name_matching(spark, sf_dir):
    """Misspelt names against the right ones."""
    supplier = table(spark, sf_dir, "supplier")
    wanted = spark.sql(TYPOS.replace("«text»", "STRING"), supplier=supplier)
    return names.match_names(wanted, spark.sql(KNOWN.replace("«text»", "STRING"), supplier=supplier))


_DOC_WORDS = f"""
d AS (
  SELECT doc_id, source, {WORDS % "coalesce(string_split(text, chr(10))[1], '')"} AS name,
         {WORDS % "coalesce(substr(text, length(string_split(text, chr(10))[1]) + 2), '')"} AS description
  FROM documents
), q AS (
  SELECT DISTINCT item_id AS query, unnest({WORDS % "coalesce(text, '')"}) AS term FROM benchmark
)"""


def _bm25_sql(name: float, description: float, doc: str = "doc_id") -> str:
    """CTEs up to ``scored`` (query, doc, score)."""
    length = "(SELECT {doc} AS doc, sum(len(name) * {n} + len(description) * {d}) AS dl FROM d GROUP BY 1)".format(doc=doc, n=float(name), d=float(description))
    return f"""
WITH {_DOC_WORDS}, t AS (
  SELECT {doc} AS doc, unnest(name) AS term, CAST({float(name)} AS DOUBLE) AS w FROM d UNION ALL SELECT {doc}, unnest(description), CAST({float(description)} AS DOUBLE) FROM d
), tf AS (SELECT doc, term, sum(w) AS tf FROM t GROUP BY doc, term), l AS {length},
totals AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM l),
idf AS (SELECT term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf, totals GROUP BY term, n),
scored AS (
  SELECT query, tf.doc, round(sum(idf * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score
  FROM q JOIN tf USING (term) JOIN idf USING (term) JOIN l ON l.doc = tf.doc, totals GROUP BY query, tf.doc
)"""


_TOP = "SELECT query, doc AS doc_id, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM scored) WHERE rank <= 10"

ORACLES = {
    "fold_texts": f"SELECT doc_id, sha256({Q.fold('text')}) AS folded, sha256(lower(translate(text, 'Iİ', 'ıi'))) AS lowered FROM documents",
    "stem_counts": f"""
SELECT CASE WHEN regexp_matches(w, '^[0-9]+$') THEN w ELSE regexp_replace(regexp_replace(regexp_replace(w, '{Q._STEM}', '\\1'), '{Q._STEM}', '\\1'), '{Q._STEM}', '\\1') END AS stem, count(*) AS n
FROM (SELECT unnest({WORDS % "text"}) AS w FROM documents) GROUP BY 1""",
    "text_keys": f"SELECT item_id, array_to_string({WORDS % 'text'}, ' ') AS text_key FROM benchmark",
    "camel_parts": r"SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(p_name, ' ', '_'), '_', ' ', 'g'), '(\p{Ll})(\p{Lu})', '\1 \2', 'g'), '(\d)([^\d ])', '\1 \2', 'g'), '([^\d ])(\d)', '\1 \2', 'g'), ' +', ' ', 'g')) AS parts FROM part",
    "slugs": f"SELECT p_partkey, trim(regexp_replace({Q.fold('s')}, '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM (SELECT p_partkey, substr(p_name || ' ' || p_type, 1, 40) AS s FROM part)",
    "clipped": r"""SELECT doc_id, CASE WHEN length(t) <= 70 THEN t WHEN contains(substr(t, 1, 70), ' ') THEN regexp_extract(substr(t, 1, 70), '^(.*) [^ ]*$', 1) || '…' ELSE substr(t, 1, 70) || '…' END AS clipped
FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)""",
    "split_terms": "SELECT item_id, CAST(len(list_filter(list_transform(regexp_split_to_array(text, '[,;]'), lambda x: trim(x)), lambda x: x <> '')) AS BIGINT) AS n_terms FROM benchmark",
    "normal_forms": r"SELECT s_suppkey, lower(regexp_replace(s_name, '\s', '', 'g')) AS normal FROM supplier",
    "bm25_top": _bm25_sql(1, 1) + _TOP,
    "bm25_fields": _bm25_sql(3, 1) + _TOP,
    "index_reloaded": _bm25_sql(3, 1) + _TOP,
    "tokens": f"SELECT item_id, array_to_string({Q.tokens('text')}, ' ') AS tokens FROM benchmark",
    "retrieval_metrics": _bm25_sql(1, 1) + """
, gold AS (SELECT item_id AS query, doc_id AS doc FROM benchmark b JOIN documents d ON contains(d.text, b.text) WHERE b.text <> ''),
top AS (SELECT query, doc, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM scored) WHERE rank <= 10),
f AS (SELECT gold.query, min(rank) AS rank FROM gold LEFT JOIN top ON top.query = gold.query AND top.doc = gold.doc GROUP BY gold.query)
SELECT count(*) AS n, round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0 END), 4) AS recall_1, round(avg(CASE WHEN rank <= 3 THEN 1.0 ELSE 0 END), 4) AS recall_3, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0 END), 4) AS recall_5,
       round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0 END), 4) AS recall_10, round(avg(coalesce(1 / rank, 0)), 4) AS mrr, (SELECT count(DISTINCT item_id) FROM benchmark WHERE text <> '') AS asked FROM f""",
    "name_matching": f"""
WITH l AS (SELECT DISTINCT name, lower(trim(trim(name), '.')) AS n FROM ({TYPOS.replace("«text»", "VARCHAR").replace("{supplier}", "supplier")})),
r AS (SELECT DISTINCT name AS matched, lower(name) AS n FROM ({KNOWN.replace("«text»", "VARCHAR").replace("{supplier}", "supplier")})),
e AS (SELECT name, matched, 'exact' AS stage FROM l JOIN r ON name = matched),
s AS (SELECT name, matched, 'normal' AS stage FROM l JOIN r USING (n) WHERE name NOT IN (SELECT name FROM e)),
d AS (SELECT name, matched, 'edit' AS stage FROM l JOIN r ON damerau_levenshtein(l.n, r.n) = 1 AND l.n[1] = r.n[1] AND length(regexp_replace(l.n, '[^0-9]', '', 'g')) = length(regexp_replace(r.n, '[^0-9]', '', 'g'))
  WHERE name NOT IN (SELECT name FROM e UNION SELECT name FROM s)),
o AS (SELECT name, min(matched) AS matched, min(stage) AS stage FROM (SELECT * FROM s UNION ALL SELECT * FROM d) GROUP BY name HAVING count(*) = 1),
k AS (SELECT matched FROM (SELECT * FROM e UNION ALL SELECT * FROM o) GROUP BY matched HAVING count(DISTINCT lower(trim(name))) = 1)
SELECT l.name, f.matched, f.stage FROM l LEFT JOIN (SELECT * FROM e UNION ALL SELECT * FROM o WHERE matched IN (SELECT matched FROM k)) f USING (name)""",
}
QUERIES = {
    f.__name__: f
    for f in (fold_texts, stem_counts, text_keys, camel_parts, slugs, clipped, split_terms, normal_forms, tokens, bm25_top, bm25_fields, index_reloaded, retrieval_metrics, name_matching)
}
