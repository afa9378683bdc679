"""Columns of the same words are scored once, in narrow rows, and all of them are returned."""

import os

import pytest
from pyspark.sql import functions as F

from quarrymap.operators import bm25, expand, features, scoring
from quarrymap.plans import ask, desk
from quarrymap.session import shared_folder

KINDS = [
    ("D.S.vLoan", "vLoan", "LoanRate", "kredi oranı, rate", "kredi faiz oranı", "G2"),
    ("D.S.vLoan", "vLoan", "CustomerId", None, "müşteri numarası", None),
    ("D.S.vLoan", "vLoan", "DataDate", "", "veri tarihi", None),
    ("D.S.vCard", "vCard", "CardLimit", "kart limiti (toplam, genel)", "kart limiti, müşteri bazlı değil", "G1"),
    ("D.S.vNone", "vNone", "Zzz", "", None, None),
]
GROUPS = [(0, "kredi", ["loan", "finansman"], "", ""), (1, "kart", ["card"], "", "Kapsam: fiziki")]
SCHEMA = "id long, object_key string, object_name string, column_name string, synonyms string, description string, dataset_group string"


@pytest.fixture(scope="module")
def tables(spark):
    columns = spark.createDataFrame([(k * len(KINDS) + i, *kind) for k in range(12) for i, kind in enumerate(KINDS)], SCHEMA)
    words = spark.createDataFrame(GROUPS, "gid int, term string, equivalents array<string>, domain string, note string")
    q = expand.expand(spark.createDataFrame([(1, "aylık müşteri kredi oranı"), (2, "kart limiti"), (3, "zzz")], "query int, text string"), words)
    return columns, q


@pytest.mark.parametrize("pool", [7, 1000])
def test_wordings_score_as_their_columns(tables, pool):
    columns, q = tables
    plain = features.build_features(columns)
    firsts, every = features.wordings(columns)
    f = features.build_features(firsts)
    assert f.count() == len(KINDS) and every.count() == 12 * len(KINDS)
    one, other = scoring.weigh_concepts(q, plain), scoring.weigh_concepts(q, f)
    weights = lambda df: [(r.query, r.weights, r.unknown) for r in df.orderBy("query").collect()]
    assert weights(one) == weights(other)
    a = scoring.column_scores(one, plain, bm25.build(plain, "id", bm25.COLUMN_WEIGHTS), pool)
    b = scoring.column_scores(other, f, bm25.build(f, "id", bm25.COLUMN_WEIGHTS, "n_columns"), pool, every)
    rows = lambda df: sorted((r.query, r.id, round(r.relative, 6), r.covered, r.signals, r.caveats, round(r.raw_score, 6)) for r in df.collect())
    assert rows(a) == rows(b.withColumnRenamed("id", "first").join(every, "first"))
    ra, rb = scoring.rank_tables(one, a, None), scoring.rank_tables(other, b, None, features=f)
    table = lambda df: sorted((r.query, r.object_key, r.best.id, r.covered, r.groups, r.dimension, r.time_column, r.score, r.rank) for r in df.collect())
    assert table(ra) == table(rb)
    shown = lambda df: sorted((r.query, r.object_key, r.place, r.id, r.column_name, r.role) for r in df.collect())
    got = shown(scoring.related_columns(b, rb, every=every))
    assert got == shown(scoring.related_columns(a, ra)) and any(place == scoring.RELATED for _, _, place, *_ in got)


def test_each_of_cuts_inside_a_wording(spark):
    found = spark.createDataFrame([(1, 0, 2.0), (1, 1, 2.0), (1, 2, 1.0)], "query int, doc long, score double")
    every = spark.createDataFrame([(0, 0), (5, 0), (1, 1), (3, 1), (2, 2)], "id long, first long")
    assert [(r.doc, r.rank) for r in bm25.each_of(found, every, 3).orderBy("rank").collect()] == [(0, 1), (1, 2), (3, 3)]


def test_scores_leave_little_in_the_shared_folder(spark):
    def held():
        folder = shared_folder(spark).removeprefix("file:")
        return sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(folder) for f in files)

    before = held()
    ask.column_scores(spark, "/root/testdata/sf0.001").agg(F.count(F.lit(1))).collect()
    assert held() - before < 2_000_000  # 5 MB and more with the questions' concepts and the columns' tokens in every row


def test_more_definitions_than_a_server_may_have(spark, tmp_path):
    from quarrymap.sources import catalog as C

    n = 2 * C.MAX_TABLES
    spark.range(n).select(F.col("id").alias("s_suppkey"), F.lit(0).alias("s_nationkey"), F.concat(F.lit("S"), "id").alias("s_name")).write.parquet(str(tmp_path / "supplier.parquet"))
    spark.createDataFrame([(0, "N")], "n_nationkey int, n_name string").write.parquet(str(tmp_path / "nation.parquet"))
    rows = desk.source_definitions(spark, str(tmp_path)).collect()
    assert sorted(r.pos for r in rows) == list(range(n - len(range(0, n, 9))))


def test_letters_after_zzz(spark):
    from quarrymap.functions import text as X

    rows = spark.createDataFrame([(18277,), (18278,), (18279,)], "n int").select(X.column_letter(F.col("n"))).collect()
    assert [r[0] for r in rows] == ["ZZZ", "AAAA", "AAAB"]
