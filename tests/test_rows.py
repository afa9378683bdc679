"""Scores are worked out in the columns' own rows: nothing is dealt for each question and column."""

import pytest
from pyspark.sql import functions as F

from quarrymap.operators import bm25, expand, features, scoring
from test_wordings import GROUPS, KINDS, SCHEMA

COPIES = 400


@pytest.fixture(scope="module")
def asked(spark):
    rows = [(k * len(KINDS) + i, key, name, f"{column}{k}", *rest) for k in range(COPIES) for i, (key, name, column, *rest) in enumerate(KINDS)]
    columns = spark.createDataFrame(rows, SCHEMA)
    words = spark.createDataFrame(GROUPS, "gid int, term string, equivalents array<string>, domain string, note string")
    texts = [(i, t) for i, t in enumerate(["aylık müşteri kredi oranı", "kart limiti", "zzz", "veri tarihi", "kredi faiz oranı", "qqqq"])]
    q = expand.expand(spark.createDataFrame(texts, "query int, text string"), words)
    f = features.build_features(columns).localCheckpoint()
    return columns, q, f


def shuffled(spark):
    """Rows written for shuffles so far in this session."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    none, jvm = sc._gateway.new_array(sc._jvm.double, 0), sc._jvm
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, none, jvm.java.util.ArrayList())
    return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (stages.apply(i) for i in range(stages.size()))}


def test_no_row_for_each_question_and_column_is_dealt(spark, asked):
    _, q, f = asked
    before = shuffled(spark)
    weighed = scoring.weigh_concepts(q, f)
    scored = scoring.column_scores(weighed, f, bm25.build(f, "id", bm25.COLUMN_WEIGHTS), pool=50)
    rows = scored.count()
    after = shuffled(spark)
    assert rows > 3 * COPIES
    assert sum(n for k, n in after.items() if k not in before) < rows  # several times as many when scores were joined by keys


def test_scores_in_rows_are_those_of_dealt_tokens(asked):
    _, q, f = asked
    terms = q.select("query", F.explode("terms").alias("t")).select("query", "t.term", "t.weight")
    index = bm25.build(f, "id", bm25.COLUMN_WEIGHTS)
    rows = bm25.in_rows(f, index, terms).select("id", F.explode("hits").alias("h")).select("h.query", "id", "h.score")
    got = {(r.query, r.id): r.score for r in rows.collect()}
    want = {(r.query, r.doc): r.score for r in bm25.scores(index, terms).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=2e-6) for k in got)


def test_many_terms_give_the_same(asked, monkeypatch):
    _, q, f = asked
    index = bm25.build(f, "id", bm25.COLUMN_WEIGHTS)
    weights = lambda df: [(r.query, r.weights, r.unknown) for r in df.orderBy("query").collect()]
    rows = lambda df: sorted((r.query, r.id, round(r.relative, 5), r.covered, r.signals, r.caveats, round(r.raw_score, 5)) for r in df.collect())
    one = scoring.weigh_concepts(q, f)
    a = rows(scoring.column_scores(one, f, index))
    monkeypatch.setattr(bm25, "ROW_TERMS", 0)
    monkeypatch.setattr(expand, "ROW_PHRASES", 0)
    other = scoring.weigh_concepts(q, f)
    assert weights(one) == weights(other)
    assert a == rows(scoring.column_scores(other, f, index)) and a


def test_columns_behind_some_wordings(spark):
    columns = spark.createDataFrame([(k * len(KINDS) + i, *kind) for k in range(3) for i, kind in enumerate(KINDS)], SCHEMA)
    firsts, every = features.wordings(columns)
    members = features.Members(columns, firsts)
    pairs = lambda df: sorted((r.id, r.first) for r in df.collect())
    assert pairs(members.all()) == pairs(every)
    assert pairs(members.of(spark.createDataFrame([(1,), (4,), (1,)], "first long"))) == [p for p in pairs(every) if p[1] in (1, 4)]
