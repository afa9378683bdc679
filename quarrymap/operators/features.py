"""Search features of a dictionary's columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymap.functions import text as X
from quarrymap.session import bounded, checkpointed

#: Wordings that are broadcast at most to find their columns; beyond, both sides are dealt.
WANTED = 200_000


def wordings(columns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``columns`` with one row, that of the smallest id, for all that differ in their id only, and ``n_columns``, how many
    they are; (id, first) of all columns). Scores don't read the id, so one row of each wording is enough to score all."""
    firsts = columns.groupBy(*_rest(columns)).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n_columns"))
    return firsts, Members(columns, firsts).all()


def _rest(columns: DataFrame) -> list[str]:
    return [c for c in columns.columns if c != "id"]


@dataclass
class Members:
    """The columns (id, ..) behind wordings (id, ..), found when they are asked for: nothing is kept for those that aren't."""

    columns: DataFrame
    firsts: DataFrame

    def _digest(self) -> Column:
        return F.unhex(F.substring(F.sha2(F.to_json(F.struct(*_rest(self.columns))), 256), 1, 32)).alias("wording")

    def _joined(self, firsts: DataFrame) -> DataFrame:
        return self.columns.select("id", self._digest()).join(firsts, "wording").select("id", "first")

    def all(self) -> DataFrame:
        """(id, first) of all columns."""
        return self._joined(self.firsts.select(F.col("id").alias("first"), self._digest()))

    def of(self, some: DataFrame) -> DataFrame:
        """(id, first) of the columns whose wordings are in ``some`` (first)."""
        wanted = bounded(checkpointed(some.select("first").distinct()), WANTED)
        firsts = self.firsts.select(F.col("id").alias("first"), *_rest(self.columns)).join(wanted, "first", "left_semi")
        return self._joined(bounded(checkpointed(firsts.select("first", self._digest())), WANTED))


def members_of(every: DataFrame | Members, some: DataFrame) -> DataFrame:
    """(id, first) of the columns of ``some`` (first) at least."""
    return every.of(some) if isinstance(every, Members) else every


def copies(features: DataFrame) -> Column:
    """How many columns a row stands for: ``n_columns`` of ``wordings``, or one."""
    return F.col("n_columns") if "n_columns" in features.columns else F.lit(1).cast("long")


def build_features(columns: DataFrame, stopwords: list[str] | None = None) -> DataFrame:
    """``columns`` (id, object_key, object_name, column_name, synonyms, description, ..) with token arrays.

    name and object with whole compounds, synonyms (one array for each) and description without; ``name_folded`` for exact
    names; ``tokens``: what a concept can be met by.
    """
    phrases = F.filter(F.transform(X.split_synonyms(F.col("synonyms")), lambda s: X.tokenize(s, stopwords, compounds=False)), lambda p: F.size(p) > 0)
    made = columns.withColumns(
        {
            "name_folded": F.replace(X.fold(F.col("column_name")), F.lit("_"), F.lit("")),
            "f_name": X.tokenize(F.col("column_name"), stopwords),
            "f_synonyms": phrases,
            "f_description": X.tokenize(F.coalesce("description", F.lit("")), stopwords, compounds=False),
            "f_object": X.tokenize(F.col("object_name"), stopwords),
        }
    )
    return made.withColumn("tokens", F.array_distinct(F.concat("f_name", F.flatten("f_synonyms"), "f_description")))
