import math

from quarrymap.operators import bm25, names


def test_bm25_matches_formula(spark):
    docs = spark.createDataFrame([(1, ["a", "b"]), (2, ["a"]), (3, [])], "id long, t array<string>")
    index = bm25.build(docs, "id", {"t": 1})
    found = bm25.search(index, spark.createDataFrame([(0, "a", 1.0)], "query long, term string, weight double")).collect()
    idf, avg = math.log(1 + (3 - 2 + 0.5) / 2.5), 1.0
    want = {d: round(idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * dl / avg)), 6) for d, dl in ((1, 2), (2, 1))}
    assert {r.doc: r.score for r in found} == want
    assert [r.doc for r in sorted(found, key=lambda r: r["rank"])] == [2, 1]


def test_match_names(spark):
    known = spark.createDataFrame([("Customer",), ("RiskScore1",), ("Account_Main",)], "name string")
    wanted = spark.createDataFrame([("Customerr",), ("RiskScore2",), ("account_main",), ("Nothing",)], "name string")
    found = {r.name: (r.matched, r.stage) for r in names.match_names(wanted, known).collect()}
    assert found == {"Customerr": ("Customer", "edit"), "RiskScore2": (None, None), "account_main": ("Account_Main", "normal"), "Nothing": (None, None)}
    for typo in ("Custmer", "Cutsomer", "Custamer"):
        assert names.match_names(spark.createDataFrame([(typo,)], "name string"), known).first().matched == "Customer"
