"""A dictionary's definitions, catalog and code as a database has them: over JDBC, or any frames of the same columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymap.functions.text import casefold

# Limits and layers.
MAX_TABLES, MAX_COLUMNS = 5_000, 200_000
CODE_LAYERS = ["EDW", "EDWLRY", "EDWSKEY", "EDWUTIL"]
OBJECTS_SQL = "SELECT '{name}' AS [database], s.name AS [schema], o.name AS [name], o.type AS [type] FROM [{name}].sys.objects o JOIN [{name}].sys.schemas s ON s.schema_id = o.schema_id WHERE o.type IN ('V', 'P')"
COLUMNS_SQL = "SELECT '{name}' AS [database], s.name AS [schema], o.name AS [table], c.name AS [name] FROM [{name}].sys.columns c JOIN [{name}].sys.objects o ON o.object_id = c.object_id JOIN [{name}].sys.schemas s ON s.schema_id = o.schema_id WHERE o.type = 'V'"
MODULES_SQL = "SELECT '{name}' AS [database], s.name AS [schema], o.name AS [name], m.definition AS [body] FROM [{name}].sys.sql_modules m JOIN [{name}].sys.objects o ON o.object_id = m.object_id JOIN [{name}].sys.schemas s ON s.schema_id = o.schema_id WHERE o.type IN ('V', 'P')"


class SourceInvalid(Exception):
    """A source has more than a dictionary can have, or nothing."""


def jdbc(spark: SparkSession, options: dict[str, str], query: str) -> DataFrame:
    """The rows of a query of a database; ``options``: url, user, password, driver.."""
    return spark.read.format("jdbc").options(**options).option("query", query).load()


def of_database(spark: SparkSession, options: dict[str, str], sql: str, name: str) -> DataFrame:
    """One of the fixed queries for a database; its name may hold nothing that would end its brackets or quotes."""
    if not name or any(c in name for c in "[]'\";"):
        raise SourceInvalid(f"database name {name!r}")
    return jdbc(spark, options, sql.format(name=name))


def _text(value: Column) -> Column:
    """Trimmed text; the word NULL stands for none."""
    bare = F.trim(F.coalesce(value.cast("string"), F.lit("")))
    return F.when(F.lower(bare) == "null", "").otherwise(bare)


def definitions(rows: DataFrame, key: list[str], limit: int | None = None) -> tuple[DataFrame, int]:
    """(rows with a full key, trimmed, numbered by ``pos`` in an order that doesn't depend on the server; rows without one).

    More than ``limit`` distinct keys are an error: a server with so many is no source. Without a limit all rows are taken.
    """
    texts = rows.select(*(_text(F.col(f"`{c}`")).alias(c) for c in rows.columns))
    full = F.lit(True)
    for k in key:
        full = full & (F.col(k) != "")
    whole = texts.where(full)
    if limit is not None and whole.select(*(casefold(F.col(k)).alias(k) for k in key)).distinct().limit(limit + 1).count() > limit:
        raise SourceInvalid("limit")
    from quarrymap.operators.records import dense_ids

    order = F.struct(*(casefold(F.col(c)).alias(f"f_{c}") for c in rows.columns), *rows.columns, F.monotonically_increasing_id().alias("tie"))
    return dense_ids(whole.withColumn("_qm_order", order), "_qm_order", "pos").drop("_qm_order"), texts.where(~full).count()


def in_scope(rows: DataFrame, databases: list[str], columns: list[str], schemas: list[str] = (), prefixes: list[str] = (), column: str | None = None, object: str | None = None) -> DataFrame:
    """Rows without the databases, schemas, objects by the beginning of their names, and columns that are left out."""
    low = lambda names: [n.strip().casefold() for n in names]
    out = rows.where(~casefold(F.col("database")).isin(low(databases)) if databases else F.lit(True))
    if schemas:
        out = out.where(~casefold(F.trim("schema")).isin(low(schemas)))
    for prefix in low(prefixes) if object else ():
        out = out.where(~casefold(F.trim(object)).startswith(prefix))
    return out.where(~casefold(F.trim(column)).isin(low(columns))) if column and columns else out


def catalog(objects: DataFrame, columns: DataFrame) -> DataFrame:
    """(database, schema, name, columns): the sorted columns of a view, null for a procedure, whose columns nobody can see."""
    held = columns.groupBy("database", "schema", F.col("table").alias("name")).agg(F.array_sort(F.collect_set(columns["name"])).alias("columns"))
    seen = F.coalesce("columns", F.array().cast("array<string>"))
    return objects.join(held, ["database", "schema", "name"], "left").select("database", "schema", "name", F.when(F.trim("type") == "V", seen).alias("columns"))


def modules(parts: dict[str, DataFrame]) -> DataFrame:
    """(key, body) of the layers' definitions; a layer that could not be read is simply not among them."""
    out = None
    for rows in parts.values():
        some = rows.select(F.concat_ws(".", "database", "schema", "name").alias("key"), F.coalesce("body", F.lit("")).alias("body"))
        out = some if out is None else out.unionByName(some)
    if out is None:
        raise SourceInvalid("no code")
    return out


def probe(tables: DataFrame, columns: DataFrame, changed: str) -> DataFrame:
    """One row: how many tables and columns a read would bring, and the latest change; nothing is kept."""
    t = tables.agg(F.count_distinct("database", "schema", "name").alias("tables"), F.max(changed).alias("a"))
    c = columns.agg(F.count_distinct("database", "schema", "table", "name").alias("columns"), F.max(changed).alias("b"))
    return t.crossJoin(F.broadcast(c)).select("tables", "columns", F.greatest("a", "b").alias("last_change"))  # one row each
