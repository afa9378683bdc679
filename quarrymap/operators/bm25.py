"""Field-weighted BM25 as an index of DataFrames and a ranked search of many queries at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrymap.operators import features as of_columns
from quarrymap.session import bounded, checkpointed

#: Distinct asked terms that are broadcast at most; beyond, tokens and terms are both dealt.
ASKED_TERMS = 200_000
#: Distinct terms and queries that are looked up in a row of arrays at most; beyond, tokens are dealt.
ROW_TERMS, ROW_QUERIES = 1000, 200
#: Found rows that are broadcast at most to find the documents behind them.
FOUND = 200_000
# Weights of a column's fields, and of a table's.
COLUMN_WEIGHTS = {"f_name": 3.0, "f_synonyms": 2.0, "f_description": 1.0, "f_object": 1.0}
TABLE_WEIGHTS = {"object": 4.0, "name": 1.0, "synonyms": 1.0, "description": 0.3, "profile": 3.0}


@dataclass
class Index:
    """tokens (doc, term, w), of which a term of a document may have several; docs (doc, dl), one row for each document.

    Where docs has ``n``, a row stands for so many documents of the same words. ``fields``: the token-array columns and their
    weights, where each document is one row of them.
    """

    tokens: DataFrame
    docs: DataFrame
    fields: dict[str, float] | None = None

    def totals(self) -> DataFrame:
        """One row: the number of documents and their mean length."""
        if "n" in self.docs.columns:
            return self.docs.agg(F.sum("n").alias("n"), (F.sum(F.col("dl") * F.col("n")) / F.sum("n")).alias("avgdl"))
        return self.docs.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))

    def postings(self) -> DataFrame:
        """(doc, term, tf) of all terms."""
        return self.tokens.groupBy("doc", "term").agg(F.sum("w").alias("tf"))

    def save(self, path: str) -> None:
        """Writes the postings and lengths beside an index that is in use; whoever swaps them reads the new folder."""
        self.postings().withColumnRenamed("tf", "w").write.mode("overwrite").parquet(f"{path}/tokens")
        self.docs.write.mode("overwrite").parquet(f"{path}/docs")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Index:
        return Index(spark.read.parquet(f"{path}/tokens"), spark.read.parquet(f"{path}/docs"))


def _flat(df: DataFrame, field: str):
    """A field as one token array; fields of phrases hold arrays of them."""
    return F.flatten(field) if df.schema[field].dataType.elementType.typeName() == "array" else F.col(field)


def _length(docs: DataFrame, fields: dict[str, float]):
    return sum((F.size(_flat(docs, f)) * F.lit(float(w)) for f, w in fields.items()), F.lit(0.0))


def build(docs: DataFrame, id: str, fields: dict[str, float], copies: str | None = None) -> Index:
    """The index of token-array columns; fields without a positive weight are left out. ``copies``: how many documents a row is."""
    used = {f: w for f, w in fields.items() if w > 0}
    weighed = [F.transform(_flat(docs, f), _weigh(w)) for f, w in used.items()]
    tokens = docs.select(F.col(id).alias("doc"), F.explode(F.concat(*weighed)).alias("t")).select("doc", "t.term", "t.w")
    lengths = docs.select(F.col(id).alias("doc"), _length(docs, used).alias("dl"), *([] if copies is None else [F.col(copies).alias("n")]))
    return Index(tokens, lengths, used)


def build_tables(features: DataFrame, profiles: DataFrame | None = None, weights: dict[str, float] | None = None) -> Index:
    """One document for each table of the columns' features: its name once, its columns' fields, its profile (object_key, f_profile)."""
    w, n = TABLE_WEIGHTS if weights is None else weights, of_columns.copies(features).cast("double")
    rows = features.select("object_key", F.concat(*(F.transform(_flat(features, f"f_{k}"), _weigh(w[k], n)) for k in ("name", "synonyms", "description"))).alias("t"))
    names = features.groupBy("object_key").agg(F.min_by("f_object", "id").alias("f")).select("object_key", F.transform("f", _weigh(w["object"])).alias("t"))
    rows = rows.unionByName(names)
    if profiles is not None:
        rows = rows.unionByName(profiles.select("object_key", F.transform("f_profile", _weigh(w["profile"])).alias("t")))
    lengths = rows.groupBy(F.col("object_key").alias("doc")).agg(F.sum(F.aggregate("t", F.lit(0.0), lambda n, t: n + t["w"])).alias("dl"))
    return Index(rows.select(F.col("object_key").alias("doc"), F.explode("t").alias("t")).select("doc", "t.term", "t.w"), lengths)


def _weigh(w: float, n=None):
    weight = F.lit(float(w)) if n is None else F.lit(float(w)) * n
    return lambda t: F.struct(t.alias("term"), weight.alias("w"))


def scores(index: Index, queries: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query, doc, score) of every document that holds a term; ``queries`` is (query, term, weight).

    Only tokens that are asked for leave the scan; document frequencies come from the same rows.
    """
    asked = bounded(queries.select("term").distinct(), ASKED_TERMS)
    tf = index.tokens.join(asked, "term", "left_semi").groupBy("term", "doc").agg(F.sum("w").alias("tf"))
    totals = F.broadcast(index.totals())  # one row
    held = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    if "n" in index.docs.columns:
        held = tf.join(index.docs.select("doc", "n"), "doc").groupBy("term").agg(F.sum("n").alias("df"))
    idf = held.crossJoin(totals).select("term", "avgdl", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    wanted = queries.join(idf, "term")
    hits = tf.join(wanted, "term").join(index.docs.select("doc", "dl"), "doc")
    part = F.col("weight") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return hits.groupBy("query", "doc").agg(F.round(F.sum(part), 6).alias("score"))


def in_rows(docs: DataFrame, index: Index, queries: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame | None:
    """``docs``, the rows that ``index`` was built of, with ``hits``: (query, score) of the queries a row holds a term of.

    A document's tokens are all in its row, so its scores are worked out there and nothing is dealt: the queries' weighted terms
    come to every row, as one array by query for each term. None where there are too many for that; ``scores`` has no bound.
    """
    terms = checkpointed(queries.groupBy("query", "term").agg(F.sum("weight").alias("weight")))
    if index.fields is None or terms.select("term").distinct().count() > ROW_TERMS or terms.select("query").distinct().count() > ROW_QUERIES:
        return None
    flat = [(_flat(docs, f), w) for f, w in index.fields.items()]
    asked = F.broadcast(terms.agg(F.collect_set("term").alias("asked")))  # one row
    own = docs.crossJoin(asked).withColumn("own", F.array_intersect(F.concat(*(t for t, _ in flat)), "asked")).drop("asked")
    df = own.select(F.explode("own").alias("term"), of_columns.copies(docs).alias("n")).groupBy("term").agg(F.sum("n").alias("df"))
    idf = df.crossJoin(F.broadcast(index.totals())).select("term", "avgdl", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    each = terms.join(idf, "term").groupBy("term").agg(F.map_from_entries(F.collect_list(F.struct("query", (F.col("weight") * F.col("idf")).alias("w")))).alias("by"), F.first("avgdl").alias("avgdl"))
    every = F.broadcast(terms.agg(F.array_sort(F.collect_set("query")).alias("queries")))  # one row
    each = each.crossJoin(every).select("term", "queries", "avgdl", F.transform("queries", lambda q: F.try_element_at("by", q)).alias("w"))
    table = checkpointed(each.agg(F.map_from_entries(F.collect_list(F.struct("term", "w"))).alias("weights"), F.first("queries").alias("queries"), F.first("avgdl").alias("avgdl")))
    rows = own.withColumn("dl", _length(docs, index.fields)).crossJoin(F.broadcast(table))
    tf = lambda t: sum((F.size(F.filter(x, lambda y: y == t)) * F.lit(float(w)) for x, w in flat), F.lit(0.0))
    held = F.transform("own", lambda t: F.struct(t.alias("term"), tf(t).alias("tf")))

    def add(done, t):
        part = lambda w: w * t["tf"] * (k1 + 1) / (t["tf"] + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
        return F.zip_with(done, F.element_at("weights", t["term"]), lambda d, w: F.when(w.isNull(), d).otherwise(F.coalesce(d, F.lit(0.0)) + part(w)))

    sums = F.aggregate(held, F.transform("queries", lambda _: F.lit(None).cast("double")), add)
    hits = F.filter(F.zip_with("queries", sums, lambda q, s: F.struct(q.alias("query"), F.round(s, 6).alias("score"))), lambda h: h["score"].isNotNull())
    none = F.array().cast(f"array<struct<query:{terms.schema['query'].dataType.simpleString()},score:double>>")
    return rows.select(*docs.columns, F.coalesce(hits, none).alias("hits"))


def search(index: Index, queries: DataFrame, k: int = 10, k1: float = 1.2, b: float = 0.75, docs: DataFrame | None = None) -> DataFrame:
    """(query, doc, score, rank) of the best k for every query; ties go to the smaller document.

    A query's rows are cut to k in every task before they meet. ``docs``: rows (id, ..) that the index was built of, to be
    scored in their rows (``in_rows``) if that can be.
    """
    order = Window.partitionBy("query").orderBy(F.desc("score"), "doc")
    rows = None if docs is None else in_rows(docs, index, queries, k1, b)
    found = scores(index, queries, k1, b) if rows is None else rows.select(F.col("id").alias("doc"), F.explode("hits").alias("h")).select("h.query", "doc", "h.score")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def each_of(found: DataFrame, every: DataFrame | of_columns.Members, k: int) -> DataFrame:
    """(query, first, doc, score, rank): the best k documents, of ``found``, the best k rows where a row stands for several.

    ``every``: (id, first), the documents and the smallest of their kind, which is the row's. No other row can hold one of the
    best k: k smaller documents of at least its score are before it.
    """
    order = Window.partitionBy("query").orderBy(F.desc("score"), "doc")
    rows = checkpointed(found.select("query", F.col("doc").alias("first"), "score"))
    rows = of_columns.members_of(every, rows).withColumnRenamed("id", "doc").join(bounded(rows, FOUND), "first")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def relative(scored: DataFrame) -> DataFrame:
    """(query, doc, score, relative): scores over the query's best, by an aggregate rather than a window over its documents."""
    best = scored.groupBy("query").agg(F.max("score").alias("best")).where("best > 0")
    return scored.join(best, "query").select("query", "doc", "score", (F.col("score") / F.col("best")).alias("relative"))
