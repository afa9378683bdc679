"""Versions, uploads and sources on small tables."""

import pytest
from pyspark.sql import functions as F

from quarrymap.functions import keys
from quarrymap.sinks import reports
from quarrymap.sinks import store as S
from quarrymap.sources import catalog as C
from quarrymap.sources import dictionary as U


def test_versions(spark, tmp_path):
    store = S.Store(spark, f"file://{tmp_path}/s")
    assert store.versions("a") == [] and store.active("a") is None
    with pytest.raises(KeyError):
        store.read("a")
    first = store.write("a", spark.range(3), at=0.0)
    assert store.write("a", spark.range(3).repartition(2), at=1.0) == first  # the same content is no new version
    second = store.write("a", spark.range(5), at=2.0)
    assert [v["status"] for v in store.versions("a")] == ["previous", "active"] and store.read("a").count() == 5
    assert store.read("a", first["id"], checked=True).count() == 3
    back = store.rollback("a", first["id"])
    assert store.read("a").count() == 3 and back["digest"] == first["digest"] and store.rollback("a", second["id"])["rows"] == 5
    frames, digests = store.pinned(["a", "none"])
    assert frames["a"].count() == 5 and list(digests) == ["a"]
    assert S.stale({"a": "x"}, digests, ["a"]) == ["a"] and S.stale(digests, digests, ["a"]) == []
    spark.range(1).write.mode("overwrite").parquet(f"file://{tmp_path}/s/a/{store.active('a')['id']}")
    with pytest.raises(ValueError):
        store.read("a", checked=True)
    assert store.prune("a", 1, now=10.0**12) == 3 and len(store.versions("a")) == 1


def test_newest(spark):
    rows = spark.createDataFrame([(1, "a", 1), (2, "a", 3), (3, "b", 2), (4, "c", 9)], "id int, k string, at int")
    assert sorted(r.id for r in S.newest(rows, ["k"], ["at"], 2).collect()) == [2, 4]
    assert sorted(r.id for r in S.newest_of_owner(rows, "k", ["at"], 1).collect()) == [2, 3, 4]


def test_term_lists(spark):
    uploads = {
        "good": [["Terim:"], [" Kredi  kartı "], [None], ["KREDİ KARTI"], ["oran"]],
        "odd header": [["Başlık"], ["x"]],
        "wide": [["Terim", None], ["x", "y"]],
        "aside": [[None, "Terim"], [None, "x"]],
        "empty": [[None], [""]],
        "no header": [[None], ["x"]],
        "only header": [["Terim"]],
        "long": [["Terim"], ["x" * 501]],
        "many": [["Terim"], *[[f"t{i}"] for i in range(201)]],
    }
    cells = spark.createDataFrame([(u, i + 1, c) for u, rows in uploads.items() for i, c in enumerate(rows)], "upload string, row int, cells array<string>")
    got = {r.upload: (r.reason, r.terms, r.notes) for r in U.term_list(cells).collect()}
    assert got["good"] == (None, ["Kredi kartı", "oran"], ["1 blank", "1 repeated"])
    assert got["odd header"] == (None, ["x"], ["header not searched: Başlık"])
    reasons = {u: r for u, (r, *_) in got.items() if r}
    assert reasons == {"wide": "layout_invalid: data in A, B", "aside": "layout_invalid: terms in B", "empty": "layout_invalid: empty", "no header": "layout_invalid: no header", "only header": "layout_invalid: no terms", "long": "term_too_long: row 2", "many": "too_many_terms: 201"}


def test_template_warnings():
    assert U.template_warnings({U.OBJECTS_SHEET: U.OBJECT_FIELDS, U.COLUMNS_SHEET: U.COLUMN_FIELDS}) == []
    assert U.template_warnings({U.OBJECTS_SHEET: [f for f in U.OBJECT_FIELDS if f != "ObjectKey"], U.COLUMNS_SHEET: U.COLUMN_FIELDS[:6]}) == ["Kolonlar: Role", "Kolonlar: Summary"]
    missing = U.template_warnings({U.OBJECTS_SHEET: ["Grain"], U.COLUMNS_SHEET: [f.lower() for f in U.COLUMN_FIELDS]})
    assert "Objeler: ObjectKey" in missing and "Objeler: SchemaName" in missing and "Objeler: Grain" not in missing


def test_seeds(spark, tmp_path):
    (tmp_path / "terms.jsonl").write_text('{"term": "kart", "equivalents": ["card"], "domain": "", "note": ""}\n{"term": "", "equivalents": ["x"]}\n')
    items = U.read_seeds(spark, str(tmp_path / "terms.jsonl")).withColumn("row", F.monotonically_increasing_id() + 1)
    checked = U.check_terms(items)
    assert [(r.term, r.failure) for r in checked.orderBy("row").collect()] == [("kart", None), ("", "vocabulary_term_empty")]
    assert U.refused(checked).first().failure == "vocabulary_term_empty" and U.refused(checked.limit(0)).first().failure is None


def test_sources(spark):
    rows = spark.createDataFrame([("d", "s", " b "), ("d", "s", "A"), ("d", "", "x"), ("d", "null", "y"), ("d", "s", "a")], "database string, schema string, name string")
    found, skipped = C.definitions(rows, ["database", "schema", "name"], 5)
    assert skipped == 2 and [r.name for r in found.orderBy("pos").collect()] == ["A", "a", "b"]
    with pytest.raises(C.SourceInvalid):
        C.definitions(rows, ["database", "schema", "name"], 1)
    with pytest.raises(C.SourceInvalid):
        C.of_database(spark, {}, C.OBJECTS_SQL, "x]; DROP")
    left = C.in_scope(spark.createDataFrame([("A", "s", "prm_x", "c"), ("B", "s", "v", "Flag"), ("B", "s", "v", "c"), ("B", "Un", "v", "c")], "database string, schema string, name string, column string"), ["a"], ["FLAG"], ["un"], ["prm_"], column="column", object="name")
    assert [tuple(r) for r in left.collect()] == [("B", "s", "v", "c")]
    objects = spark.createDataFrame([("d", "s", "v", "V "), ("d", "s", "p", "P "), ("d", "s", "w", "V")], "database string, schema string, name string, type string")
    held = spark.createDataFrame([("d", "s", "v", "b"), ("d", "s", "v", "a")], "database string, schema string, table string, name string")
    assert {r.name: r.columns for r in C.catalog(objects, held).collect()} == {"v": ["a", "b"], "p": None, "w": []}
    code = spark.createDataFrame([("d", "s", "v", None)], "database string, schema string, name string, body string")
    assert [tuple(r) for r in C.modules({"EDW": code}).collect()] == [("d.s.v", "")]


def test_keys(spark):
    import hashlib
    import json

    rows = [{"a": 'x"ş', "b": "1"}, {"a": "\n", "b": ""}]
    frame = spark.createDataFrame([(i, r["b"], r["a"]) for i, r in enumerate(rows)], "i int, b string, a string")
    assert keys.canonical_digest(frame, "i", ["b", "a"]).first().digest == hashlib.sha256(json.dumps(rows, ensure_ascii=False, sort_keys=True).encode()).hexdigest()[:12]
    group = {"term": "a", "equivalents": ["b"], "domain": "", "note": ""}
    one = keys.fingerprint({"search": {"k": 1}, "cache": {"x": 1}, "analyst": {"top": 1, "shortlist_max_tokens": 5}}, {"model": "m"}, "v1", [group], 5, ["ve"], "p")
    same = keys.fingerprint({"search": {"k": 1}, "cache": {"x": 2}, "analyst": {"top": 1, "shortlist_max_tokens": 9}}, {"model": "m", "name": "n"}, "v1", [group], 5, ["ve"], "p")
    assert one == same != keys.fingerprint({"search": {"k": 2}, "analyst": {"top": 1}}, {"model": "m"}, "v1", [group], 5, ["ve"], "p")


def test_list_report(spark):
    make = spark.createDataFrame
    questions = make([(1, "a"), (2, "b"), (3, "c"), (4, "d")], "query int, text string")
    answers = make([(1, "VAR", [], None), (2, "BULUNAMADI", ["x"], None), (3, None, None, "failed")], "query int, verdict string, missing array<string>, error string")
    ranked = make([(1, 1, "k", 0.876, "Yüksek"), (2, 1, "k", 0.2, "Düşük")], "query int, rank int, object_key string, score double, level string")
    rows = reports.summary(questions, answers, ranked)
    assert [(r.query, r.state, r.best, r.score, r.missing) for r in rows.orderBy("query").collect()] == [(1, "VAR", "k", 0.88, "-"), (2, "BULUNAMADI", "-", None, "x"), (3, "HATA", "-", None, "-"), (4, "BEKLİYOR", "-", None, "-")]
    assert tuple(reports.outcome(rows).first()) == (4, 1, 0, 1, 1, 1)
