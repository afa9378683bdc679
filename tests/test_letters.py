"""Letters of a sheet's columns: against the SQL as far as it goes (three letters, and null), against the rule beyond."""

import duckdb
import pytest
from pyspark.sql import functions as F

from quarrymap.functions import text as X
from quarrymap.plans import desk


def rule(n):
    letters, n = "", n + 1
    while n:
        n, digit = divmod(n - 1, 26)
        letters = chr(65 + digit) + letters
    return letters


def test_against_sql_to_zzz_and_null(spark, tmp_path):
    con = duckdb.connect()
    con.execute(f"COPY (SELECT range AS p_partkey FROM range(18278) UNION ALL SELECT NULL) TO '{tmp_path}/part.parquet'")
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet'")
    got = {r.p_partkey: r.letters for r in desk.column_letters(spark, str(tmp_path)).collect()}
    assert got == dict(con.execute(desk.ORACLES["column_letters"]).fetchall())


@pytest.mark.parametrize(("kind", "number"), [("int", 2**31 - 1), ("bigint", 18278), ("bigint", 26**4 + 18277), ("bigint", 26**4 + 18278), ("bigint", 2**53 + 1), ("bigint", 2**63 - 2)])
def test_exact_beyond_three_letters(spark, kind, number):
    assert spark.createDataFrame([(number,)], f"n {kind}").select(X.column_letter(F.col("n"))).first()[0] == rule(number)
