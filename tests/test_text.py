import pytest
from pyspark.sql import functions as F

from quarrymap.functions import text as X


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v"))).first()[0]


@pytest.mark.parametrize(("value", "want"), [("İHTİYAÇ", "ihtiyaç"), ("KIRILIM", "kırılım"), ("IİŞĞÜÖÇ", "ıişğüöç"), (None, None), ("", "")])
def test_tr_lower(spark, value, want):
    assert one(spark, X.tr_lower, value) == want


def test_fold(spark):
    assert one(spark, X.fold, "Müşteri İhtiyaç Kâr") == "musteri ihtiyac kar"


@pytest.mark.parametrize(("value", "want"), [("IFRSStage", "IFRS Stage"), ("Avg30d", "Avg 30 d"), ("SWIFTCountL12M", "SWIFT Count L 12 M"), ("KKB_DATE", "KKB DATE"), ("vPRCArrayAllotment", "v PRC Array Allotment")])
def test_split_camel(spark, value, want):
    assert " ".join(one(spark, X.split_camel, value)) == want


@pytest.mark.parametrize(("value", "want"), [("transferi", "transfer"), ("transferler", "transfer"), ("transferlerin", "transfer"), ("transferlerinin", "transfer"), ("data", "data"), ("2024", "2024")])
def test_stem(spark, value, want):
    assert one(spark, X.stem, value) == want


def test_tokenize(spark):
    assert one(spark, lambda c: X.tokenize(c, [], stems=False), "CardLimitFullnessToday") == ["card", "limit", "fullness", "today", "cardlimitfullnesstoday"]
    assert "bilgi" not in one(spark, X.tokenize, "risk bilgisi")


def test_contains_sequence(spark):
    df = spark.createDataFrame([(["a", "b", "c"], ["b", "c"]), (["a", "b"], ["a", "c"]), (["ab"], ["b"]), (["a"], [])], "h array<string>, n array<string>")
    assert [r[0] for r in df.select(X.contains_sequence(F.col("h"), F.col("n"))).collect()] == [True, False, False, False]


def test_small_functions(spark):
    assert one(spark, lambda c: X.clip(c, 10), "one  two three") == "one two…"
    assert one(spark, X.slugify, "Ödeme Tarihi!") == "odeme_tarihi"
    assert one(spark, X.normal_form, " 'Kredi Kart.' ") == "kredikart"
    assert one(spark, X.cell, "5.0") == "5" and one(spark, X.cell, None) == ""
    assert one(spark, lambda c: X.ngrams(c, 2), ["a", "b"], "array<string>") == ["a", "b", "a b"]
