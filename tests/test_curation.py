"""Curation rules on texts with known results, and over frames."""

import pytest
from pyspark.sql import functions as F

from quarrymap.functions import curation as C
from quarrymap.operators import curation as O


@pytest.mark.parametrize(
    ("text", "want", "removed"),
    [
        ("Müşterinin şube kodudur. Değerin anlamı iş birimi ile doğrulanmalıdır.", "Müşterinin şube kodudur.", ["Değerin anlamı iş birimi ile doğrulanmalıdır."]),
        ("Kayıt tarihidir; kapsamı iş birimi ile doğrulanmalıdır.", "Kayıt tarihidir.", ["Kayıt tarihidir; kapsamı iş birimi ile doğrulanmalıdır."]),
        ("Kartın EMV bayrağı olması beklenmektedir.", "Kartın EMV bayrağı.", ["Kartın EMV bayrağı olması beklenmektedir."]),
        ("[MODEL TAHMİNİ - DOĞRULANMALI] Şube adıdır.", "Şube adıdır.", ["[MODEL TAHMİNİ - DOĞRULANMALI]"]),
        ("Plain.", "Plain.", []),
        ("", "", []),
    ],
)
def test_doubt(text, want, removed):
    assert C.without_doubt(text) == (want, removed)
    assert C.without_doubt(want) == (want, [])


@pytest.mark.parametrize("sentence", ["Bu tutarın altındaki işlemlerde SMS bildirimi tetiklenmeyebilir.", "Havale dışındaki ödemelerde kullanılmayabilir.", "Değer boş olabilir.", "Şube bazlı analizlerde temel kırılım olarak kullanılır."])
def test_hedges(sentence):
    assert C.without_hedges(f"Kartın limit tutarıdır. {sentence}") == ("Kartın limit tutarıdır.", [sentence])


def test_hedged_words_and_examples():
    assert C.without_hedges("Tutar genellikle ay sonu bakiyesidir.")[0] == "Tutar ay sonu bakiyesidir."
    assert C.without_hedges("Temlik türünün okunabilir adıdır.") == ("Temlik türünün okunabilir adıdır.", [])
    assert C.without_hedges("Döviz kodudur (ör. TRY, USD).") == ("Döviz kodudur.", ["(ör. TRY, USD)"])
    assert C.without_hedges("Döviz kodudur (ör. TRY, USD).", "... 'TRY' ...") == ("Döviz kodudur (ör. TRY, USD).", [])
    assert C.sentences("Kalem kodudur (ör. 1.9). İkinci cümle.") == ["Kalem kodudur (ör. 1.9).", "İkinci cümle."]


@pytest.mark.parametrize(
    ("before", "after"),
    [
        ("Faiz tutarıdır.", "Kar payı tutarıdır."), ("Kredinin faiz oranıdır.", "Fon kullandırımının kar payı oranıdır."), ("Mevduat hesabının bakiyesidir.", "Katılma hesabının bakiyesidir."), ("Leasing fon ödemesinin tarihidir.", "İcare fon ödemesinin tarihidir."),
        ("Kredi kartı limitidir.", "Kredi kartı limitidir."), ("Faizsiz finansman tutarıdır.", "Faizsiz finansman tutarıdır."), ("Mevduat faizidir.", "Katılma hesabı kar payıdır."), ("Projenin faizinin toplamıdır.", "Projenin kar payının toplamıdır."),
        ("Faize esas tutardır.", "Kar payına esas tutardır."), ("Kod 'Bireysel Krediler' yazar.", "Kod 'Bireysel Krediler' yazar."),
    ],
)
def test_wording(before, after):
    assert C.house_wording(before) == after == C.house_wording(after)


def test_synonyms_and_summaries():
    assert C.clean_synonyms("VKN, vergi numarası, TCKN (bazı durumlarda), tax ID") == "VKN, vergi numarası, tax ID"
    assert C.clean_synonyms("etiket, Label, label, etiket") == "etiket, Label, label"
    once = C.clean_synonyms("katılma hesabı bakiyesi", "Katılma hesabının bakiyesidir.")
    assert once == "katılma hesabı bakiyesi, mevduat" == C.clean_synonyms(once, "Katılma hesabının bakiyesidir.")
    assert C.clean_synonyms("", "Kar payı tutarıdır.") == ""
    assert C.clean_summary("Müşteri sınıfı · Bireysel/KOBİ/Ticari/Kurumsal") == "Müşteri sınıfı"
    assert C.clean_summary("Döviz cinsi kodu (TRY, USD, EUR)") == "Döviz cinsi kodu"
    assert C.clean_summary("Araç tipi (Yatırım Fonu, Hisse Senedi, Sukuk)", "Yatırım Fonu Hisse Senedi Sukuk") == "Araç tipi (Yatırım Fonu, Hisse Senedi, Sukuk)"
    assert C.clean_summary("Kalem kodu (ör. 1.9) · olası değerler doğrulanmalı") == "Kalem kodu"
    long = "Müşterinin son on iki aydaki ortalama katılma hesabı bakiyesi toplamının Türk lirası karşılığı"
    assert len(C.clean_summary(long)) <= 70 and long.startswith(C.clean_summary(long))
    assert C.capital("icare projesidir.") == "İcare projesidir." and C.capital("iOS sürümüdür.") == "iOS sürümüdür."


@pytest.mark.parametrize(
    "text",
    ["Müşterinin sınıfıdır (kod ya da ad, objeye göre değişebilir; ör. Bireysel, KOBİ). Teklif sahibinin sınıfıdır.", "[MODEL TAHMİNİ] Kredinin faiz oranıdır; iş birimi ile doğrulanmalıdır. Leasing projesidir.", "Tutar genellikle ay sonu bakiyesidir (ör. 100, 200). Eş anlamlılar: tutar."],
)
def test_rules_once_are_enough(text):
    once, _ = C.clean_description(text)
    assert once and C.clean_description(once) == (once, [])


def test_aligned_objects(spark):
    rows = [("a", "customerid, Missing, CustomerId", "Datadate", "Teminat × Veri tarihi", "Kârlılık"), ("b", "CollateralId", "DataDate, Period", "Müşteri × Periyot (ay)", "x"), ("c", "CollateralId", "DataDate", "Teminat", None), ("d", None, None, None, None)]
    columns = [(k, c) for k in "abc" for c in ("CustomerId", "CollateralId", "DataDate", "Period")]
    made = O.align_objects(spark.createDataFrame(rows, "object_key string, KeyColumns string, TimeColumns string, Grain string, BusinessDomain string"), spark.createDataFrame(columns, "object_key string, column_name string"), {"Kârlılık": "Karlılık"})
    got = {r.object_key: (r.KeyColumns, r.TimeColumns, r.BusinessDomain) for r in made.collect()}
    assert got == {"a": ("CustomerId, DataDate", "DataDate", "Karlılık"), "b": ("CollateralId, Period", "DataDate, Period", "x"), "c": ("CollateralId", "DataDate", ""), "d": ("", "", "")}


def test_object_code(spark):
    definitions = spark.createDataFrame([("D.S.vA", "view"), ("D.S.ins_A", "load 'x y'"), ("D.S.B", "b")], "key string, body string")
    found = O.object_code(definitions, spark.createDataFrame([("D.S.vA",), ("D.S.B",), ("D.S.C",)], "object_key string"))
    assert {r.object_key: r.bodies for r in found.collect()} == {"D.S.vA": ["view", "load 'x y'"], "D.S.B": ["b"]}
    assert {r.object_key: r.text for r in O.literals_of(found).collect()} == {"D.S.vA": "x y", "D.S.B": ""}


def test_scores_and_intervals(spark):
    rows = spark.createDataFrame([(0, 10, 0, 0, 10, 0, 5), (1, 0, 0, 0, 0, 0, 0), (0, 0, 0, 0, 3, 3, 1), (0, 9, 0, 1, 10, 0, 5)], "failed int, r int, m int, w int, calls int, failures int, scope int")
    c = F.col
    made = O.score_card(c("failed"), c("r"), c("m"), c("w"), c("calls"), c("failures"), c("scope"))
    got = [(x.score, x.verdict) for x in rows.select(*(v.alias(k) for k, v in made.items())).collect()]
    assert got == [(100, O.APPROVE), (90, O.REVIEW), (0, O.REJECT), (90, O.APPROVE)]
    low, high = rows.select(O.wilson(F.lit(0), F.lit(0)).alias("a"), O.wilson(F.lit(5), F.lit(5)).alias("b")).first()
    assert (low.low, low.high) == (0.0, 0.0) and high.high == 1.0 and 0.5 < high.low < 0.6


def test_samples_are_the_same(spark):
    rows = spark.range(1000)
    a = {r.id for r in O.sample_rows(rows, ["id"], 50, 3).collect()}
    assert len(a) == 50 and a == {r.id for r in O.sample_rows(rows.repartition(9), ["id"], 50, 3).collect()}
    assert a != {r.id for r in O.sample_rows(rows, ["id"], 50, 4).collect()}
