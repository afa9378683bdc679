"""Names, places and the account of a source, on small made-up ones."""

import pytest

from quarrymap.operators import names as N


def matched(spark, wanted, known, **options):
    rows = N.match_names(spark.createDataFrame([(w,) for w in wanted], "name string"), spark.createDataFrame([(k,) for k in known], "name string"), **options).collect()
    return {r.name: r.matched for r in rows}


@pytest.mark.parametrize(
    ("wanted", "known", "want"),
    [
        (["Customer", "Customerz"], ["Customer", "Customers"], {"Customer": "Customer", "Customerz": None}),  # two near names
        (["customerr", "CUSTOMERR"], ["Customer"], {"customerr": "Customer", "CUSTOMERR": "Customer"}),  # one row in two spellings
        (["", ".."], ["..", "x"], {"": None, "..": ".."}),
        (["Customer", " customer"], ["Customer"], {"Customer": "Customer", " customer": "Customer"}),  # one row, once exactly
        (["Cus tomer", "Customerr"], ["Customer"], {"Cus tomer": None, "Customerr": None}),  # two rows
        (["Account1", "Acount"], ["Account"], {"Account1": None, "Acount": "Account"}),
        (["vCard", "Straße"], ["Card", "STRASSE"], {"vCard": None, "Straße": "STRASSE"}),
        ([], ["x"], {}),
        (["x"], [], {"x": None}),
    ],
)
def test_matching(spark, wanted, known, want):
    assert matched(spark, wanted, known) == want


def test_shared_names(spark):
    assert matched(spark, ["crm", "CRM ", "Crmx"], ["CRM"], edits=False, exclusive=False) == {"crm": "CRM", "CRM ": "CRM", "Crmx": None}


def frames(spark):
    tables = [(0, "dwh", "CRM", "vCustomers", ""), (1, "dwh", "crm ", "vCustomer", "first"), (2, "dwh", "CRM", "vCustomer", "second"), (3, "dwh", "CRM", "vNothing", "x"), (4, "dwh", "CRM", "vIdle", "y"), (5, "other", "CRM", "vCustomer", "z"), (6, "dwh", "CRM", "rpt_Day", "p"), (7, "dwh", "CRM", "vMoved", "m"), (8, "dwh", "CRM", "vEmpty", "e")]
    columns = [
        (0, "dwh", "CRM", "vCustomer", "CustomerId", "", "g1"), (1, "dwh", "CRM", "vCustomer", "CustomerId", "the id", "g2"), (2, "dwh", "CRM", "vCustomer", "Balanse", "b", "g"), (3, "dwh", "CRM", "vCustomer", "Missing", "m", "g"),
        (4, "dwh", "CRM", "vLost", "A", "", ""), (5, "dwh", "CRM", "rpt_Day", "day", "", ""), (6, "dwh", "CRM", "rpt_Day", "DAY", "d", ""), (7, "dwh", "CRM", "vMoved", "Id", "", ""), (8, "dwh", "CRM", "vEmpty", "Nope", "", ""), (9, "other", "CRM", "vCustomer", "x", "", ""),
    ]
    catalog = [("DWH", "CRM", "vCustomer", True), ("DWH", "CRM", "vIdle", True), ("DWH", "CRM", "rpt_Day", False), ("DWH", "SAL", "vMoved", True), ("DWH", "CRM", "vEmpty", True)]
    held = [("DWH", "CRM", "vCustomer", "CustomerId"), ("DWH", "CRM", "vCustomer", "Balance"), ("DWH", "SAL", "vMoved", "Id"), ("DWH", "CRM", "vEmpty", "Yes")]
    make = spark.createDataFrame
    return (
        make(tables, "pos int, database string, schema string, name string, description string"),
        make(columns, "pos int, database string, schema string, table string, name string, description string, group string"),
        make([("dwh", "DWH")], "database string, to_database string"),
        make(catalog, "database string, schema string, name string, listed boolean"),
        make(held, "database string, schema string, table string, name string"),
    )


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_reconcile(spark):
    found = N.reconcile(*frames(spark))
    assert rows(found["tables"]) == [("DWH", "CRM", "rpt_Day", "p"), ("DWH", "CRM", "vCustomer", "first"), ("DWH", "SAL", "vMoved", "m")]
    assert rows(found["columns"]) == [("DWH", "CRM", "rpt_Day", "day", "d", ""), ("DWH", "CRM", "vCustomer", "Balance", "b", "g"), ("DWH", "CRM", "vCustomer", "CustomerId", "the id", "g2"), ("DWH", "SAL", "vMoved", "Id", "", "")]
    assert rows(found["excluded_tables"]) == [("dwh.CRM.vEmpty",), ("dwh.CRM.vLost",)]
    assert rows(found["excluded_columns"]) == [("DWH.CRM.vCustomer", "Missing")]
    assert rows(found["corrected_columns"]) == [("DWH.CRM.rpt_Day", "DAY", "day"), ("DWH.CRM.vCustomer", "Balanse", "Balance")]
    assert ("dwh.CRM.vMoved", "DWH.SAL.vMoved") in rows(found["corrected_tables"])
    assert rows(found["unverified_tables"]) == [("DWH.CRM.rpt_Day",)]
    # vCustomers is near vCustomer, which two rows claim; vNothing and vIdle have no columns; one doubled table, two doubled columns.
    assert rows(found["skipped"]) == [(6,)]


def test_aliases(spark):
    tables, columns, databases, catalog, held = frames(spark)
    aliases = spark.createDataFrame([("DWH.crm.VLOST", "DWH", "CRM", "vIdle"), ("dwh.CRM.vEmpty", "DWH", "CRM", "vNowhere")], "alias string, database string, schema string, name string")
    spelled = columns.selectExpr("database", "schema", "table AS name").union(tables.select("database", "schema", "name"))
    got = {(r.schema, r.name): r.to_name for r in N.locate(spelled, databases, catalog, aliases).collect()}
    assert got[("CRM", "vLost")] == "vIdle" and got[("CRM", "vEmpty")] == "vEmpty" and got[("CRM", "vNothing")] is None
