"""Questions, scores and answers on a few columns, by hand."""

import math

import pytest
from pyspark.sql import functions as F

from quarrymap.operators import analyst, bm25, expand, features, scoring

COLUMNS = [
    (0, "D.S.vLoan", "vLoan", "LoanRate", "kredi oranı, rate", "kredi faiz oranı", "G2"),
    (1, "D.S.vLoan", "vLoan", "CustomerId", "", "müşteri numarası", "G1"),
    (2, "D.S.vLoan", "vLoan", "DataDate", "", "veri tarihi", None),
    (3, "D.S.vCard", "vCard", "CardLimit", "kart limiti (toplam, genel)", "kart limiti, müşteri bazlı değil", "G1"),
    (4, "D.S.vCard", "vCard", "ProductTypeName", "", "ürün tipi adı", "G1"),
    (5, "D.S.vNone", "vNone", "Zzz", "", "başka", None),
]
GROUPS = [(0, "kredi", ["loan", "finansman"], "", ""), (1, "kart", ["card"], "", "Kapsam: fiziki"), (2, "oran", ["rate"], "Finansal", "")]


@pytest.fixture(scope="module")
def asked(spark):
    f = features.build_features(spark.createDataFrame(COLUMNS, "id long, object_key string, object_name string, column_name string, synonyms string, description string, dataset_group string"))
    words = spark.createDataFrame(GROUPS, "gid int, term string, equivalents array<string>, domain string, note string")
    texts = [(1, "aylık müşteri kredi oranı"), (2, "CardLimit"), (3, "kart limiti kırılımlı (ihtiyaç, konut)"), (4, "")]
    q = scoring.weigh_concepts(expand.expand(spark.createDataFrame(texts, "query int, text string"), words), f)
    return f, q


def test_expand(asked):
    _, q = asked
    rows = {r.query: r for r in q.collect()}
    labels = lambda k: [(c.kind, c.label) for c in rows[k].concepts]
    assert labels(1) == [("zaman", "aylık"), ("terim", "kredi"), ("ölçü", "oran"), ("terim", "müşteri")]
    assert labels(2) == [("terim", "card"), ("terim", "limit")]
    assert [c.label for c in rows[3].concepts if c.breakdown_value] == ["ihtiyaç", "konut"]
    assert rows[4].concepts == [] and rows[4].terms == []
    terms = {t.term: t.weight for t in rows[1].terms}
    assert terms["kred"] == 1.0 and terms["loan"] == 0.6 and rows[1].groups == [0, 2]
    assert [round(w, 6) for w in rows[2].weights] == [round(math.log(1 + 6 / 2), 6), round(math.log(1 + 6 / 2), 6)]
    assert rows[3].unknown == ["ihtiyaç", "konut"]


def test_scores_and_tables(asked):
    f, q = asked
    scored = scoring.column_scores(q, f, bm25.build(f, "id", bm25.COLUMN_WEIGHTS))
    got = {(r.query, r.id): r for r in scored.collect()}
    exact = got[2, 3]
    # Best by words, both concepts covered in the name, the name asked for, and a word that only the vocabulary adds.
    assert exact.rule_score == 1.0 and exact.raw_score == pytest.approx(0.35 + 0.25 + 0.30 + 0.20 + 0.10 * (len(exact.via) > 0))
    limit = got[3, 3]
    assert "Kapsam: fiziki" in limit.caveats
    assert not any("“kart”" in c for c in got[1, 0].caveats)
    rate = got[1, 0]
    assert "“kred oran”" in " ".join(rate.signals) and rate.rule_score > got[1, 1].rule_score
    ranked = scoring.rank_tables(q, scored, None)
    tables = {(r.query, r.object_key): r for r in ranked.collect()}
    loan = tables[1, "D.S.vLoan"]
    parts = {"best": loan.c_best_column, "coverage": loan.c_coverage, "time": loan.c_time, "granularity": loan.c_granularity}
    assert parts["time"] == 0.8 and parts["granularity"] == 1.0 and loan.missing == [] and parts["coverage"] == pytest.approx(1.0)
    assert loan.score == pytest.approx((0.35 * parts["best"] + 0.21 + 0.07 * 0.8 + 0.07) / (0.35 + 0.21 + 0.07 + 0.07), abs=1e-6)
    card = tables[3, "D.S.vCard"]
    assert card.long_values == ["ihtiyaç", "konut"] and card.dimension == "ProductTypeName"
    assert (5 not in [k for _, k in got]) and not any(q_ == 4 for q_, _ in got)
    answers = {r.query: r for r in scoring.rule_answer(ranked).collect()}
    assert answers[1].verdict in (scoring.PARTIAL, scoring.FOUND) and answers[1].score == pytest.approx(round(loan.score * 0.8, 4), abs=1e-4)
    told = scoring.explained(scoring.kept(ranked, least=0.0), scoring.related_columns(scored, ranked), scored)
    text = {(r.query, r.object_key): (r.reason, r.caveat) for r in told.collect()}
    assert "DataDate kolonu ile aylık seri sunuyor." in text[1, "D.S.vLoan"][0] and "Müşteri seviyesinde" in text[1, "D.S.vLoan"][0]
    assert "uzun formatta: ihtiyaç, konut değerleri ProductTypeName" in text[3, "D.S.vCard"][1]


def test_negated_concepts(spark, asked):
    f, _ = asked
    words = spark.createDataFrame(GROUPS, "gid int, term string, equivalents array<string>, domain string, note string")
    q = scoring.weigh_concepts(expand.expand(spark.createDataFrame([(1, "müşteri kartı limiti")], "query int, text string"), words), f)
    scored = scoring.column_scores(q, f, bm25.build(f, "id", bm25.COLUMN_WEIGHTS))
    caveats = {r.id: r.caveats for r in scored.collect()}
    assert any("“müşteri” bazlı değil" in c for c in caveats[3]) and not any("değil" in c for c in caveats[1])


def test_levels(spark):
    rows = spark.createDataFrame([(0.797,), (0.794,), (0.4949,), (0.5,), (1.0,)], "s double")
    assert [r[0] for r in rows.select(scoring.level(F.col("s"))).collect()] == ["Yüksek", "Orta", "Düşük", "Orta", "Yüksek"]


def test_build_answer(spark):
    make = spark.createDataFrame
    replies = make([(1, "VAR", "VAR. Tamam.", True), (2, "VAR", "Var gibi", False), (3, "YOK", "x", True), (4, "VAR", "", True), (5, "BULUNAMADI", "yok", None)], "query int, verdict string, summary string, core_found boolean")
    picks = make([(1, 0, "a", "0.9", 1), (1, 1, "b", "0.8", 1), (1, 2, "c", "0.8", 1), (1, 3, "a", "0.99", 1), (1, 4, None, "0.9", 1), (1, 5, "d", "0.2", 1), (2, 0, "a", "0.9", 1), (3, 0, "a", "1.5", 2), (4, 0, "a", "0.9", 0), (5, 0, "a", "0.9", 1)], "query int, pos int, object_key string, confidence string, n_columns int")
    core = make([(1, "b"), (1, "c"), (1, "c")], "query int, object_key string")
    answers, shown = analyst.build_answer(replies, picks, core, make([("b",)], "object_key string"))
    assert {r.query: (r.verdict, r.summary) for r in answers.collect()} == {1: ("VAR", "VAR. Tamam."), 2: ("BULUNAMADI", "BULUNAMADI. Var gibi"), 3: ("KISMEN VAR", "KISMEN VAR. x"), 4: ("BULUNAMADI", "BULUNAMADI. Talebi karşılayan, sözlükte doğrulanmış bir tablo bulunamadı."), 5: ("BULUNAMADI", "BULUNAMADI. yok")}
    assert [(r.query, r.object_key, r.confidence) for r in shown.orderBy("query", "rank").collect()] == [(1, "c", 0.9), (1, "b", 0.8), (1, "a", 0.9), (3, "a", 1.0)]
    assert [r[0] for r in make([("Yazım hatası var. Tamam.",)], "t string").select(analyst.without_spelling(F.col("t"))).collect()] == ["Tamam."]


def test_index_is_saved(spark, tmp_path, asked):
    f, _ = asked
    index = bm25.build(f, "id", bm25.COLUMN_WEIGHTS)
    index.save(str(tmp_path / "i"))
    asked_ = spark.createDataFrame([(1, "kart", 1.0), (1, "muster", 0.5)], "query int, term string, weight double")
    again = bm25.Index.load(spark, str(tmp_path / "i"))
    rows = lambda i: [(r.doc, r.score, r.rank) for r in bm25.search(i, asked_).orderBy("rank").collect()]
    assert rows(index) == rows(again) and rows(index)[0][0] == 3
