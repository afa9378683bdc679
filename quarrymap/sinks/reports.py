"""Answers as rows of report sheets, workbooks and JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of states of a list's items.
FAILED, WAITING = "HATA", "BEKLİYOR"


def result_json(ranked: DataFrame, related: DataFrame) -> DataFrame:
    """(query, rank, json): each table of an answer as JSON; numbers with four digits."""
    columns = related.groupBy("query", "object_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "column_name", "role"))), lambda c: F.struct(c["column_name"].alias("column"), c["role"].alias("role"))).alias("columns"))
    four = lambda name: F.bround(F.col(name), 4)
    parts = [c for c in ranked.columns if c.startswith("c_")]
    told = F.struct(
        "rank", F.col("object_key").alias("key"), F.col("object_name").alias("name"), "groups", four("score").alias("score"), "level", F.struct(*(four(c).alias(c[2:]) for c in parts)).alias("components"),
        F.col("covered_labels").alias("covered"), "missing", F.col("long_values").alias("long_format"), "dimension", "columns",
    )
    return ranked.join(columns, ["query", "object_key"], "left").select("query", "rank", F.to_json(told).alias("json"))


def suggestions(explained: DataFrame, related: DataFrame) -> DataFrame:
    """The rows of the suggestions sheet: a line for each table of each answer, its columns one below the other."""
    columns = related.groupBy("query", "object_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "column_name"))), lambda c: c["column_name"]), "\n").alias("columns"))
    dash = lambda c: F.when(F.coalesce(c, F.lit("")) == "", "-").otherwise(c)
    rows = explained.join(columns, ["query", "object_key"], "left")
    return rows.select("query", "rank", F.col("object_key").alias("object"), dash(F.array_join("groups", ", ")).alias("groups"), "columns", "reason", "caveat", F.bround("score", 2).alias("score"), "level", "usage")


def summary(questions: DataFrame, answers: DataFrame, ranked: DataFrame) -> DataFrame:
    """The summary sheet of a list: a row for each term with its state, best table, score, level and what is missing."""
    best = ranked.where("rank = 1").select("query", F.col("object_key").alias("best"), F.bround("score", 2).alias("score"), "level")
    rows = questions.join(answers.select("query", "verdict", "missing", "error"), "query", "left").join(best, "query", "left")
    state = F.when(F.col("error").isNotNull(), FAILED).when(F.col("verdict").isNull(), WAITING).otherwise(F.col("verdict"))
    found = state.isin(FAILED, WAITING, "BULUNAMADI")
    blank: Column = F.lit("-")
    return rows.select(
        "query", "text", state.alias("state"), F.when(found, blank).otherwise(F.coalesce("best", blank)).alias("best"), F.when(~found, F.col("score")).alias("score"), F.when(found, blank).otherwise(F.coalesce("level", blank)).alias("level"),
        F.when(F.coalesce(F.size("missing"), F.lit(0)) > 0, F.array_join("missing", ", ")).otherwise(blank).alias("missing"),
    )


def outcome(summarised: DataFrame) -> DataFrame:
    """One row: how many terms, and how many of each state."""
    n = lambda s: F.count(F.when(F.col("state") == s, 1))
    return summarised.agg(F.count(F.lit(1)).alias("terms"), n("VAR").alias("found"), n("KISMEN VAR").alias("partial"), n("BULUNAMADI").alias("not_found"), n(FAILED).alias("failed"), n(WAITING).alias("unanswered"))
