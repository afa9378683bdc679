"""Relational queries in SQL that Spark and other engines read alike."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarrymap.session import table

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def spark_query(sql: str, dialect: dict[str, str] | None = None) -> Callable[[SparkSession, str], DataFrame]:
    """A query of SQL in which tables stand in braces; only those are read."""
    for name, to in (dialect or {}).items():
        sql = sql.replace(name, to)
    used = [t for t in TABLES if "{" + t + "}" in sql]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in used})

    return run


def plain(sql: str, dialect: dict[str, str] | None = None) -> str:
    """The same SQL with bare table names."""
    for name, to in (dialect or {}).items():
        sql = sql.replace(name, to)
    return re.sub(r"\{(\w+)\}", r"\1", sql)
