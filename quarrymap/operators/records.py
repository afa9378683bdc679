"""Records by key: the first or last of each, and dense numbers without a global window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrymap.session import checkpointed


def dense_ids(df: DataFrame, order: str, out: str = "_id") -> DataFrame:
    """``df`` with numbers from 0 in order of the unique column ``order``.

    Rows are dealt by ranges of ``order`` and numbered within each; a range's number of rows gives the next one's first
    number. The dealt rows are written out first, so a lost executor can't deal them anew.
    """
    dealt = checkpointed(df.repartitionByRange(order).withColumn("_part", F.spark_partition_id()))
    # One row for each partition.
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = sizes.select("_part", before.alias("_first"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1
    return dealt.withColumn("_at", within).join(F.broadcast(firsts), "_part").withColumn(out, F.col("_first") + F.col("_at")).drop("_part", "_first", "_at")


def first_of_key(df: DataFrame, key: list[str], order: str, out: str = "_id") -> DataFrame:
    """The first row of every key without nulls, numbered by ``order``; aggregated before it is shuffled, so no key is too common."""
    known = df.dropna(subset=key)
    firsts = known.groupBy(*key).agg(F.min_by(F.struct(*df.columns), F.col(order)).alias("_row")).select("_row.*")
    return dense_ids(firsts, order, out)


def last_of_key(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last row of every key without nulls, as profiles of objects are read: a later row replaces an earlier one."""
    return df.dropna(subset=key).groupBy(*key).agg(F.max_by(F.struct(*df.columns), F.col(order)).alias("_row")).select("_row.*")
