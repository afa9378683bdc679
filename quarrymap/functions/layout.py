"""Values for pictures and lists: hashes, a seeded sequence, places of stars, the order of a tree, scores of a palette."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrymap.functions.text import fold

# The constants of the hash and of the sequence, the angle, the limit of a palette.
BASIS, PRIME, WORD = 2166136261, 16777619, 1 << 32
FIRST_FACTOR, SECOND_FACTOR = 2246822507, 3266489909
GOLDEN = math.pi * (3 - math.sqrt(5))
PALETTE = 60


def _times(a: Column, factor: int) -> Column:
    """a times factor modulo 2^32, without a product beyond 64 bits."""
    high, low = factor >> 16, factor & 0xFFFF
    return (((a * high) % 65536) * 65536 + a * low) % WORD


def fnv1a(text: Column) -> Column:
    """The 32-bit FNV-1a hash of a text's characters, of those beyond 16 bits by their first unit."""
    unit = lambda c: F.when(F.ascii(c) < 65536, F.ascii(c)).otherwise(F.lit(0xD800) + F.shiftright(F.ascii(c) - 65536, 10))
    characters = F.filter(F.split(text, ""), lambda c: c != "")
    return F.aggregate(characters, F.lit(BASIS).cast("long"), lambda h, c: _times(h.bitwiseXOR(unit(c).cast("long")), PRIME))


def next_state(state: Column) -> Column:
    """The next state of the seeded sequence; a state over 2^32 is its value."""
    a = _times(state.bitwiseXOR(F.shiftright(state, 15)), FIRST_FACTOR)
    return a.bitwiseXOR(_times(state.bitwiseXOR(F.shiftright(state, 13)), SECOND_FACTOR))


def clusters(items: DataFrame) -> DataFrame:
    """(group, place, n, x, y, hue): groups by size, on a spiral from the centre out; ``items``: name, group."""
    counts = items.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("first"))
    total = counts.agg(F.count(F.lit(1)).alias("groups"))
    # Groups are few; members, which may be many, are not ranked here.
    place = F.row_number().over(Window.orderBy(F.desc("n"), "first")) - 1
    rows = counts.withColumn("place", place).crossJoin(F.broadcast(total))  # one row
    radius, angle = 0.1 + 0.82 * F.sqrt((F.col("place") + 0.5) / F.col("groups")), F.col("place") * GOLDEN
    return rows.select("group", "place", "n", (F.cos(angle) * radius).alias("x"), (F.sin(angle) * radius).alias("y"), (fnv1a(F.col("group")) % 360).alias("hue"))


def tree_order(spark: SparkSession, steps: DataFrame) -> DataFrame:
    """(trace, seq, depth, path): steps (trace, seq, parent, start_ms) under their parents, siblings by start and number.

    A recursive query goes down one level of all traces at a time; ``path`` sorts the steps of a trace. Steps whose parent
    isn't there are roots.
    """
    sql = """
WITH RECURSIVE known AS (SELECT s.trace, s.seq, s.start_ms, p.seq AS parent FROM {steps} s LEFT JOIN {steps} p ON p.trace = s.trace AND p.seq = s.parent),
walk(trace, seq, depth, path) AS (
  SELECT trace, seq, 0, lpad(CAST(start_ms AS STRING), 12, '0') || lpad(CAST(seq AS STRING), 8, '0') FROM known WHERE parent IS NULL
  UNION ALL
  SELECT k.trace, k.seq, w.depth + 1, w.path || lpad(CAST(k.start_ms AS STRING), 12, '0') || lpad(CAST(k.seq AS STRING), 8, '0') FROM walk w JOIN known k ON k.trace = w.trace AND k.parent = w.seq
) SELECT trace, seq, depth, path FROM walk"""
    return spark.sql(sql, steps=steps)


def palette_score(title: Column, subtitle: Column, words: Column) -> Column:
    """3 for each word in the title or 1 in the subtitle, 2 more where the title begins with it; null unless all words occur."""
    name, whole = fold(title), fold(F.concat_ws(" ", title, F.coalesce(subtitle, F.lit(""))))
    score = lambda n, w: n + F.when(F.contains(name, w), 3).otherwise(1) + F.when(F.startswith(name, w), 2).otherwise(0)
    return F.when(F.forall(words, lambda w: F.contains(whole, w)), F.aggregate(words, F.lit(0), score))


def exact_table(wanted: DataFrame, tables: DataFrame) -> DataFrame:
    """(wanted, object_key): the one table whose key, or the end of its key after a dot, is the text, ignoring case and the two letters i.

    Every end of every key is one row, so that texts meet tables by equality; texts with white space, and of several tables, find none.
    """
    low = lambda c: F.translate(F.lower(F.translate(c, "Iİ", "ıi")), "ı", "i")
    parts = F.split(low(F.col("object_key")), r"\.")
    ends = tables.select("object_key", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))).alias("_qm_end")).distinct()
    asked = wanted.select("wanted").distinct().withColumn("_qm_end", low(F.trim("wanted"))).where(~F.col("_qm_end").rlike(r"\s") & (F.col("_qm_end") != ""))
    one = asked.join(ends, "_qm_end").groupBy("wanted").agg(F.count(F.lit(1)).alias("n"), F.min("object_key").alias("object_key")).where("n = 1").drop("n")
    return wanted.join(one, "wanted", "left")
