import pytest
from pyspark.sql import functions as F

from quarrymap.functions.replies import salvage, salvaged
from quarrymap.operators.merge import digests, merge, picked
from quarrymap.operators.records import first_of_key, last_of_key
from quarrymap.sources.workbook import read_workbooks, records, workbook_bytes, write_workbook
from quarrymap.streaming.rate import limited, limited_stream


@pytest.mark.parametrize(
    ("reply", "want"),
    [
        ('{"a":[{"b":1},{"c":', {"a": [{"b": 1}]}),
        ('<think>{"x":{}</think>{"a":{"b":"}]"},"c":"[{', {"a": {"b": "}]"}}),
        ('{"a":[1,2],"b":"x\\"]', {"a": [1, 2]}),
        ('{"a":1}', None),
        ('{"a":"b', None),
        ("no object", None),
        ("", None),
        (None, None),
        ('{"a":[{}],"b" x {"c":[', {"a": [{}]}),
    ],
)
def test_salvage(reply, want):
    assert salvage(reply) == want


def test_salvage_column(spark):
    df = spark.createDataFrame([('{"a": {"ş": 1}, "b',), (None,)], "r string")
    assert [r[0] for r in df.select(salvaged(F.col("r"))).collect()] == ['{"a":{"ş":1}}', None]


HITS = [(1, "a", 0), (2, "a", 1), (3, "a", 2), (4, "a", 10), (5, "a", 11), (6, "b", 0), (7, None, 0), (8, None, 1), (9, None, 2), (10, "", 0), (11, "a", None)]
ALLOWED = {1: True, 2: True, 3: False, 4: True, 5: True, 6: True, 7: True, 8: True, 9: False, 10: True, 11: True}


def hits(spark):
    return spark.createDataFrame(HITS, "id long, k string, s long").select("id", "k", F.timestamp_seconds(F.col("s") + 10**9).alias("t"))


def test_rate_limit(spark):
    assert {r.id: r.allowed for r in limited(hits(spark), "k", "t", "id", 2, 10).collect()} == ALLOWED
    assert limited(hits(spark).limit(0), "k", "t", "id", 2, 10).count() == 0


def test_rate_limit_on_a_stream(spark, tmp_path):
    for k in range(0, len(HITS) - 1, 4):  # several files: state is carried over
        hits(spark).where(F.col("id").between(k + 1, min(k + 4, len(HITS) - 1))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, k string, t timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = limited_stream(stream, "k", "t", "id", 2, 10, "1 hour")
    query = out.writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    rows = spark.table("limited").collect()
    assert len(rows) == len(HITS) - 1 and {r.id: r.allowed for r in rows} == {k: v for k, v in ALLOWED.items() if k < 11}


def test_workbook(spark, tmp_path):
    rows = [("name", "", "n", "n"), ("=1+1", "x", 5, 1.5), (None, None, None, None), (" a & <b> ", None, 2.0, None), ("", None, None, None)]
    (tmp_path / "a.xlsx").write_bytes(workbook_bytes({"One & two": rows, "Empty": []}))
    (tmp_path / "b.xlsx").write_bytes(b"no workbook")
    (tmp_path / "c.xlsx").write_bytes(b"x" * 5000)
    found = read_workbooks(spark, str(tmp_path), max_file=4000).collect()
    assert [r.cells for r in sorted((r for r in found if not r.error), key=lambda r: r.row)] == [["name", None, "n", "n"], ["=1+1", "x", "5", "1.5"], [], [" a & <b> ", None, "2"]]
    assert sorted(r.error for r in found if r.error) == ["too many: bytes", "unreadable: BadZipFile"]
    got = {r.row: r.record for r in records(read_workbooks(spark, str(tmp_path / "a.xlsx"))).collect()}
    assert got == {1: {"name": "=1+1", "n": "1.5"}, 2: {"name": None, "n": None}, 3: {"name": " a & <b> ", "n": None}}
    assert [r.error for r in read_workbooks(spark, str(tmp_path / "a.xlsx"), max_columns=3).collect()] == ["too many: columns"]
    write_workbook({"s": spark.range(3)}, str(tmp_path / "d.xlsx"))
    assert [r.cells for r in read_workbooks(spark, str(tmp_path / "d.xlsx")).orderBy("row").collect()] == [["id"], ["0"], ["1"], ["2"]]


def test_records_by_key(spark):
    df = spark.createDataFrame([(3, "a", "x"), (1, "b", "y"), (2, "a", "z"), (0, None, "w"), (9, "c", None)], "pos long, k string, v string")
    assert sorted((r._id, r.k, r.v) for r in first_of_key(df, ["k"], "pos").collect()) == [(0, "b", "y"), (1, "a", "z"), (2, "c", None)]
    assert sorted((r.k, r.pos) for r in last_of_key(df, ["k"], "pos").collect()) == [("a", 3), ("b", 1), ("c", 9)]
    assert first_of_key(df.limit(0), ["k"], "pos").count() == 0


@pytest.mark.parametrize(
    ("prior", "origin", "source", "cleaned", "want"),
    [
        (None, None, "s", None, ("s", "kaynak")),
        ("", "x", "", "", ("", "")),
        ("p", "", "s", None, ("p", "onceki")),
        ("p", "yonetici", "s", None, ("p", "yonetici")),
        ("p", "kaynak", "s", None, ("s", "kaynak")),
        ("p", "kaynak", None, None, ("p", "kaynak")),
        ("p", "kaynak", "s", "s", ("p", "kaynak")),
        ("p", "kaynak", "t", "s", ("t", "kaynak")),
    ],
)
def test_picked(spark, prior, origin, source, cleaned, want):
    row = spark.createDataFrame([(prior, origin, source, cleaned)], "p string, o string, s string, c string")
    assert tuple(row.select(picked(*map(F.col, "posc")).alias("x")).first().x) == want


def test_merge_of_empty_tables(spark):
    rows = spark.createDataFrame([(1, "a")], "k long, f string")
    assert [tuple(r) for r in merge(rows.limit(0), rows, ["k"], ["f"]).collect()] == [(1, "added", "a", "kaynak", "")]
    assert [tuple(r) for r in merge(rows, rows.limit(0), ["k"], ["f"]).collect()] == [(1, "removed", "a", "onceki", "a")]
    assert [r.kind for r in merge(rows, rows.limit(0), ["k"], ["f"], catalog=rows).collect()] == ["kept"]


def test_digests_know_no_order(spark):
    rows = [("a", "x", None), ("a", "y", "1"), ("b", "y", "1"), ("b", "x", ""), ("c", "x", ""), ("c", "x", ""), ("d", "x", "")]
    found = {r.k: r.digest for r in digests(spark.createDataFrame(rows, "k string, n string, d string"), ["k"], ["n", "d"]).collect()}
    assert found["a"] == found["b"] and len(set(found.values())) == 3
