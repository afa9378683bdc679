"""Names of a source against those of a catalog: matching, places of tables, and the account of what fits.

The catalog's spelling is the right one. Every step is a join; near spellings meet by what is left of them when one
character is taken out, so no name is compared with all others.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymap.functions.text import casefold, normal_form
from quarrymap.session import checkpointed

SHORTEST = 6


def single_edit(a: Column, b: Column) -> Column:
    """Whether one letter was added, left out, replaced or swapped with its neighbour; the first character stays, digits count."""
    letter = lambda c: c.rlike(r"^\p{L}$")
    at = lambda s, i: F.substring(s, i, F.lit(1))
    same = F.length(a) == F.length(b)
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.length(a), F.length(b)))), lambda i: at(a, i) != at(b, i))
    i, j = F.get(places, F.lit(0)), F.get(places, F.lit(1))
    replaced = (F.size(places) == 1) & letter(at(a, i)) & letter(at(b, i))
    swapped = (F.size(places) == 2) & (j == i + 1) & (at(a, i) == at(b, j)) & (at(a, j) == at(b, i)) & letter(at(a, i)) & letter(at(a, j))
    short, long = F.when(F.length(a) < F.length(b), a).otherwise(b), F.when(F.length(a) < F.length(b), b).otherwise(a)
    p = F.coalesce(i, F.length(short) + 1)
    rest = lambda s, k: F.substring(s, k, F.length(s))
    added = (rest(long, p + 1) == rest(short, p)) & ~at(long, p).rlike(r"^\p{N}$")
    near = (a != b) & (F.abs(F.length(a) - F.length(b)) <= 1) & (at(a, F.lit(1)) == at(b, F.lit(1)))
    enough = (F.length(a) >= SHORTEST) & (F.length(b) >= SHORTEST)
    return F.coalesce(enough & near & F.when(same, replaced | swapped).otherwise(added), F.lit(False))


def _deletions(name: Column) -> Column:
    """The name and all forms of it with one character less: two names one edit apart share one, so they can be joined by it."""
    without = F.transform(F.sequence(F.lit(1), F.length(name)), lambda i: F.concat(F.substring(name, F.lit(1), i - 1), F.substring(name, i + 1, F.length(name))))
    return F.array_distinct(F.concat(F.array(name), without))


def match_names(wanted: DataFrame, known: DataFrame, name: str = "name", by: list[str] | None = None, edits: bool = True, exclusive: bool = True) -> DataFrame:
    """(by.., name, matched, stage) for each distinct wanted name: exact, then by normal form, then, with ``edits``, by one edit.

    A candidate counts only if it is the name's only one among all known names. With ``exclusive`` a known name goes to no
    correction if names of two rows claim it, be it exactly; spellings that differ only in case are one row. ``by``: columns
    within which names are matched.
    """
    by = by or []
    left = wanted.select(*by, F.col(name).alias("name")).distinct().withColumn("n", normal_form(F.col("name")))
    right = known.select(*by, F.col(name).alias("matched")).distinct().withColumn("n", normal_form(F.col("matched")))
    left, right = checkpointed(left), checkpointed(right.where("n <> ''"))
    exact = left.join(right.select(*by, F.col("matched").alias("name")), [*by, "name"], "left_semi").select(*by, "name", F.col("name").alias("matched"), F.lit("exact").alias("stage"))
    # Names without a normal form can still be exact.
    blank = left.where("n = ''").join(known.select(*by, F.col(name).alias("name")).distinct(), [*by, "name"], "left_semi").select(*by, "name", F.col("name").alias("matched"), F.lit("exact").alias("stage"))
    exact = exact.unionByName(blank).distinct()
    rest = left.where("n <> ''").join(exact.select(*by, "name"), [*by, "name"], "left_anti")
    same = rest.join(right, [*by, "n"]).select(*by, "name", "matched", F.lit("normal").alias("stage"))
    found = same
    if edits:
        long = F.length("n") >= SHORTEST
        open_left = rest.where(long).join(same.select(*by, "name"), [*by, "name"], "left_anti")
        l_forms = open_left.select(*by, "name", F.col("n").alias("a"), F.explode(_deletions(F.col("n"))).alias("form"))
        r_forms = right.where(long).select(*by, "matched", F.col("n").alias("b"), F.explode(_deletions(F.col("n"))).alias("form"))
        near = l_forms.join(r_forms, [*by, "form"]).where(single_edit(F.col("a"), F.col("b"))).select(*by, "name", "matched").distinct()
        found = same.unionByName(near.withColumn("stage", F.lit("edit")))
    one = found.groupBy(*by, "name").agg(F.count(F.lit(1)).alias("c"), F.min("matched").alias("matched"), F.min("stage").alias("stage")).where("c = 1").drop("c")
    if exclusive:
        claims = exact.unionByName(one).groupBy(*by, "matched").agg(F.count_distinct(casefold(F.trim("name"))).alias("rows")).where("rows = 1").select(*by, "matched")
        one = one.join(claims, [*by, "matched"], "left_semi")
    return left.select(*by, "name").join(exact.unionByName(one.select(*by, "name", "matched", "stage")), [*by, "name"], "left")


def table_key(*names: str) -> Column:
    return F.concat_ws(".", *names)


def locate(spellings: DataFrame, databases: DataFrame, catalog: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(database, schema, name, to_database, to_schema, to_name) for each distinct spelling of a table; null where there is none.

    ``databases`` (database, to_database) are those in reach; spellings of others are left out. ``catalog``: database, schema,
    name. ``aliases`` (alias, database, schema, name) overrule. What is found nowhere is looked for under the same normal name
    in exactly one other schema, unless another spelling has that table or wants it too.
    """
    reach = spellings.select("database", "schema", "name").distinct().join(F.broadcast(databases), "database")  # as many as there are databases
    reach = checkpointed(reach)
    objects = checkpointed(catalog.select(F.col("database").alias("to_database"), F.col("schema").alias("to_schema"), F.col("name").alias("to_name")).distinct())
    schemas = match_names(reach.select("to_database", F.col("schema").alias("name")), objects.select("to_database", F.col("to_schema").alias("name")), by=["to_database"], edits=False, exclusive=False)
    schemas = schemas.where("matched is not null").select("to_database", F.col("name").alias("schema"), F.col("matched").alias("to_schema"))
    placed = reach.join(schemas, ["to_database", "schema"], "left")
    names = match_names(placed.where("to_schema is not null").select("to_database", "to_schema", "name"), objects.select("to_database", "to_schema", F.col("to_name").alias("name")), by=["to_database", "to_schema"])
    names = names.where("matched is not null").select("to_database", "to_schema", "name", F.col("matched").alias("to_name"))
    found = placed.join(names, ["to_database", "to_schema", "name"], "left")
    target = F.struct("to_database", "to_schema", "to_name")
    found = found.select("database", "schema", "name", F.col("to_database").alias("reach"), F.when(F.col("to_name").isNotNull(), target).alias("target"))
    if aliases is not None:
        told = aliases.select(casefold(F.col("alias")).alias("alias"), F.struct(F.col("database").alias("to_database"), F.col("schema").alias("to_schema"), F.col("name").alias("to_name")).alias("other"))
        told = told.join(objects.select(target.alias("other")), "other", "left_semi")
        found = found.withColumn("alias", casefold(table_key("database", "schema", "name"))).join(told, "alias", "left").withColumn("target", F.coalesce("other", "target")).drop("alias", "other")
    found = checkpointed(found)
    open_rows = found.where("target is null").select("database", "schema", "name", F.col("reach").alias("to_database"), normal_form(F.col("name")).alias("n"))
    elsewhere = open_rows.join(objects.withColumn("n", normal_form(F.col("to_name"))), ["to_database", "n"]).groupBy("database", "schema", "name").agg(F.count(F.lit(1)).alias("c"), F.min(target).alias("other")).where("c = 1")
    sole = elsewhere.groupBy("other").agg(F.count(F.lit(1)).alias("k")).where("k = 1").select("other")
    taken = found.where("target is not null").select(F.col("target").alias("other")).distinct()
    moved = elsewhere.join(sole, "other", "left_semi").join(taken, "other", "left_anti").select("database", "schema", "name", "other")
    return checkpointed(found.join(moved, ["database", "schema", "name"], "left").withColumn("target", F.coalesce("target", "other")).select("database", "schema", "name", "target.*"))


def reconcile(tables: DataFrame, columns: DataFrame, databases: DataFrame, catalog: DataFrame, catalog_columns: DataFrame, aliases: DataFrame | None = None) -> dict[str, DataFrame]:
    """What a catalog confirms of a source, under its spelling, and the account of the rest.

    ``tables``: pos, database, schema, name, description. ``columns``: pos, database, schema, table, name, description, group.
    ``catalog``: database, schema, name, listed (whether its columns can be seen). ``catalog_columns``: database, schema, table,
    name. Of rows for one thing the first with a description counts. The result: tables, columns, skipped (one row),
    excluded_tables, excluded_columns, corrected_tables, corrected_columns, unverified_tables.
    """
    spelled = ["database", "schema", "name"]
    to = ["to_database", "to_schema", "to_name"]
    rows = columns.withColumnRenamed("name", "column").withColumnRenamed("table", "name")
    located = locate(tables.select(*spelled).unionByName(rows.select(*spelled)), databases, catalog, aliases)
    source = casefold(table_key(*spelled))
    t = checkpointed(tables.join(located, spelled).withColumns({"source_key": table_key(*spelled), "source": source}))
    c = checkpointed(rows.join(located, spelled).withColumns({"source_key": table_key(*spelled), "source": source}))
    lost = c.where("to_name is null").groupBy("source").agg(F.min_by("source_key", "pos").alias("key"))
    idle = t.where("to_name is null").join(lost, "source", "left_anti")

    listed = catalog.select(F.col("database").alias("to_database"), F.col("schema").alias("to_schema"), F.col("name").alias("to_name"), "listed")
    c = c.where("to_name is not null").join(listed, to)
    seen = c.where("listed")
    matched = match_names(seen.select(*to, F.col("column").alias("name")), catalog_columns.select(F.col("database").alias("to_database"), F.col("schema").alias("to_schema"), F.col("table").alias("to_name"), "name"), by=to)
    matched = matched.select(*to, F.col("name").alias("column"), F.col("matched").alias("real"))
    blind = c.where("not listed").select(*to, "column", "pos").withColumn("real", F.min_by("column", "pos").over(Window.partitionBy(*to, casefold(F.col("column"))))).select(*to, "column", "real").distinct()
    c = checkpointed(c.join(matched.unionByName(blind), [*to, "column"]))
    first = lambda what, *more: F.min_by(F.struct(what, *more), F.struct((F.coalesce(F.col("description"), F.lit("")) == "").cast("int"), "pos"))
    held = c.where("real is not null").select(*to).distinct()
    with_rows = c.select(*to).distinct()
    kept_columns = c.where("real is not null").groupBy(*to, "real").agg(first("description", "group").alias("f"), F.count(F.lit(1)).alias("n"))
    described = t.where("to_name is not null").groupBy(*to).agg(first("description").alias("f"), F.count(F.lit(1)).alias("n"))
    kept_tables = held.join(described, to, "left")
    spare = described.join(with_rows, to, "left_anti").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    doubled = kept_tables.agg(F.coalesce(F.sum(F.greatest(F.col("n") - 1, F.lit(0))), F.lit(0)).alias("n")).unionAll(kept_columns.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n")))
    skipped = reduce(DataFrame.unionAll, [idle.agg(F.count(F.lit(1)).alias("n")), spare, doubled]).agg(F.sum("n").cast("long").alias("skipped"))
    spellings = t.where("to_name is not null").select(*to, "source", "source_key", F.lit(0).alias("of"), "pos").unionByName(c.select(*to, "source", "source_key", F.lit(1).alias("of"), "pos"))
    spellings = spellings.groupBy(*to, "source").agg(F.min_by("source_key", F.struct("of", "pos")).alias("source_key"))
    key = table_key(*to).alias("key")
    return {
        "tables": kept_tables.select(*(F.col(x).alias(y) for x, y in zip(to, spelled, strict=True)), F.coalesce("f.description", F.lit("")).alias("description")),
        "columns": kept_columns.select(F.col("to_database").alias("database"), F.col("to_schema").alias("schema"), F.col("to_name").alias("table"), F.col("real").alias("name"), "f.description", "f.group"),
        "skipped": skipped,
        "excluded_tables": lost.select("key").unionByName(spellings.join(with_rows, to, "left_semi").join(held, to, "left_anti").select(F.col("source_key").alias("key"))).distinct(),
        "excluded_columns": c.where("real is null").join(held, to, "left_semi").groupBy(*to, casefold(F.col("column")).alias("folded")).agg(F.min_by("column", "pos").alias("column")).select(key, "column"),
        "corrected_tables": spellings.join(held, to, "left_semi").select("source_key", key).where("source_key <> key").distinct(),
        "corrected_columns": c.where("real <> column").select(key, "column", F.col("real").alias("corrected")).distinct(),
        "unverified_tables": c.where("not listed").select(key).distinct(),
    }
