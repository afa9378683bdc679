"""Places of pattern matches in texts, by built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Values that a prefix sum adds up in one go; longer arrays are summed by blocks, so no length makes it quadratic.
BLOCK = 128


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, b: a + b)


def _small_sums(values: Column) -> Column:
    return F.transform(values, lambda _, i: _total(F.slice(values, 1, i)))


def prefix_sums(values: Column) -> Column:
    """For an array of ints, the sum of what stands before each value."""
    n = F.size(values)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), lambda b: _total(F.slice(values, b * BLOCK + 1, BLOCK)))
    starts = _small_sums(blocks)
    long = F.flatten(F.transform(starts, lambda s, b: F.transform(_small_sums(F.slice(values, b * BLOCK + 1, BLOCK)), lambda x: x + s)))
    return F.when(n == 0, F.array().cast("array<int>")).when(n <= BLOCK, _small_sums(values)).otherwise(long)


def matches(text: Column, pattern: str, where: Column | None = None) -> Column:
    """The leftmost, non-overlapping matches as array<struct<start:int, end:int, value:string>>, in code points, end exclusive.

    What stands between the matches has the lengths that give their places. The pattern must match no empty text. Texts
    that don't fulfil ``where`` aren't searched.
    """
    searched = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("between"))

    def steps(s):
        lengths = F.zip_with(F.slice(s["between"], 1, F.size(s["found"])), s["found"], lambda b, m: F.length(b) + F.length(m))
        return _once(lengths, lambda steps: F.struct(s["found"].alias("found"), F.zip_with(prefix_sums(steps), steps, lambda a, b: a + b).alias("ends")))

    def place(s):
        return F.zip_with(s["found"], s["ends"], lambda m, e: F.struct((e - F.length(m)).alias("start"), e.alias("end"), m.alias("value")))

    placed = _once(searched, lambda s: _once(steps(s), place))
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    return F.when(F.coalesce(text.rlike(pattern) if where is None else where & text.rlike(pattern), F.lit(False)), placed).otherwise(none)
