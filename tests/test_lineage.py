"""Following columns through definitions, on made-up ones."""

import pytest

from quarrymap.functions import tsql
from quarrymap.operators import lineage as L

VIEW = """/* head */
CREATE VIEW [SAL].[vOffer]
AS
SELECT o.OfferNk AS OfferId
,o.CampNk AS CampId
,c.CampaignNk AS CampaignId
,o.Tries
,(CASE WHEN K.PersonId IS NOT NULL THEN 1 ELSE 0 END) AS StaffFlag
FROM EDW.SAL.Offer o WITH (NOLOCK)
LEFT JOIN EDW.SAL.Campaign c WITH (NOLOCK) ON o.CampaignId = c.CampaignId
AND GETDATE() BETWEEN c.ValidFrom AND c.ValidUntil
LEFT JOIN EDWUTIL.DTG.KeyPerson AS K ON o.PersonId = K.PersonId
WHERE GETDATE() BETWEEN o.ValidFrom AND o.ValidUntil AND o.Written >= '2025-01-01'
"""
LOAD = """CREATE PROCEDURE [SAL].[ins_Offer](@LoadId INT) AS BEGIN
TRUNCATE TABLE EDWLRY.SAL.Offer;
INSERT INTO EDWLRY.SAL.Offer (OfferId, OfferNk, CampaignId, CampNk, Tries)
SELECT DISTINCT OK.OfferId AS OfferId, S.OfferId OfferNk,
--CASE WHEN S.CampId = 5 THEN 99 END Old,
CASE WHEN S.CampId > 0 THEN CK.CampaignId ELSE NULL END AS CampaignId,
S.CampId AS CampNk,
S.Tries
FROM EDWSTG.CRM.OFR_Offer AS S
INNER JOIN EDWKEY.SAL.OfferKey OK ON S.OfferId = OK.OfferNk;
END;"""
COMMON = """CREATE VIEW [SAL].[vReach] AS
WITH Whole AS (
SELECT P.PersonId, SUM(CASE WHEN SentOn >= DATEADD(DAY,-15,GETDATE()) THEN 1 ELSE 0 END) Whole15
FROM EDW.SAL.Offer P
INNER JOIN EDW.SAL.KeyState S ON P.StateId = S.StateId AND S.StateNk IN ('6','10')
WHERE SentOn >= DATEADD(YEAR,-2,GETDATE())
GROUP BY P.PersonId
)
SELECT W.PersonId, CASE WHEN Whole15 > 0 THEN 1 ELSE 0 END Reach15, Whole15 FROM Whole AS W
"""
SETS = """CREATE PROCEDURE [TRE].[ins_Habit] AS BEGIN
-- About to leave
SELECT a.PersonId, 9 HabitId INTO #Leaving FROM EDW.TRE.Deal a;
INSERT INTO [EDWDM].[TRE].[Habit] (PersonId, HabitId, HabitValue)
SELECT CL.PersonId, CL.HabitId, 1 AS HabitValue FROM (SELECT PersonId, HabitId FROM #Leaving) CL;
END"""
REPORT = """CREATE PROCEDURE AIS.rpt_Group AS BEGIN
SELECT P.PersonId, SUM(P.Items) AS Total INTO #Goods
FROM EDW.CON.Goods AS P WHERE P.StateId IN (1, 2) GROUP BY P.PersonId;
SELECT T.PersonId, ISNULL(T.Total, 0) AS Total
FROM #Goods AS T;
END;"""
DEFINITIONS = {
    "EDWDM.SAL.vOffer": VIEW,
    "EDWLRY.SAL.ins_Offer": LOAD,
    "EDWDM.SAL.vReach": COMMON,
    "EDWDM.TRE.ins_Habit": SETS,
    "EDWDM.TRE.vHabit": "CREATE VIEW TRE.vHabit AS SELECT T1.HabitValue, T1.HabitId FROM [EDWDM].[TRE].[Habit] T1",
    "EDWDM.SAL.vTop": "CREATE VIEW SAL.vTop AS SELECT T.Sign FROM SAL.vBase AS T UNION ALL SELECT 'x' AS Sign FROM SAL.vBase",
    "EDWDM.SAL.vBase": "CREATE VIEW SAL.vBase AS SELECT CASE WHEN S.Id IS NOT NULL THEN 'Var' ELSE 'Yok' END AS Sign FROM EDW.SAL.Src AS S",
    "Bridge.AIS.rpt_Group": REPORT,
    "Bridge.AIS.odd": "CREATE PROCEDURE AIS.odd AS BEGIN\nEXEC other @Level = 3 -- Level matters\nEND",
}


@pytest.fixture(scope="module")
def code():
    return L.Code.build(DEFINITIONS)


def test_cleaning():
    text = tsql.clean_sql("-- created by x\n--CASE WHEN a=1 THEN 2 END\nSELECT 1 -- last three months\n/* a\nb */\n")
    assert text == "SELECT 1 -- last three months"


@pytest.mark.parametrize(
    ("text", "want"),
    [("p.Nk AS Id", ("Id", "p.Nk")), ("S.Id Nk", ("Nk", "S.Id")), ("Total = a + b", ("Total", "a + b")), ("p.Tries", ("Tries", "p.Tries")), ("CASE WHEN a=1 THEN 1 ELSE 0 END Flag", ("Flag", "CASE WHEN a=1 THEN 1 ELSE 0 END")), ("[A].[B]", ("B", "[A].[B]")), ("SUM(x)", ("", "SUM(x)")), ("'it''s' AS [W]", ("W", "'it''s'"))],
)
def test_select_items(text, want):
    assert tsql.select_item(text) == want


def test_split():
    assert tsql.split_top("a, ISNULL(b, 0) c, CASE WHEN x IN (1,2) THEN 1, 2 END d, 'x,y' e") == ["a", "ISNULL(b, 0) c", "CASE WHEN x IN (1,2) THEN 1, 2 END d", "'x,y' e"]


def test_query():
    query = tsql.view_query(tsql.clean_sql(VIEW))
    assert query.sources == {"o": "edw.sal.offer", "c": "edw.sal.campaign", "k": "edwutil.dtg.keyperson"}
    assert query.ordered == ["OfferId", "CampId", "CampaignId", "Tries", "StaffFlag"]
    assert query.where.startswith("WHERE GETDATE()") and "Written" in query.where and set(query.joins) == {"c", "k"}
    assert tsql.parse_query("SELECT TOP (3) a FROM x UNION SELECT a FROM y").branches == 2


def test_writes(code):
    (write,) = tsql.writes_of("edwlry.sal.ins_offer", code.objects["edwlry.sal.ins_offer"])["edwlry.sal.offer"]
    assert write.columns == ["OfferId", "OfferNk", "CampaignId", "CampNk", "Tries"] and write.query.ordered[1] == "OfferNk"
    assert set(code.temporary["edwdm.tre.ins_habit"]) == {"#leaving"} and "edwdm.tre.habit" in code.writers


CASES = [
    ("EDWDM.SAL.vOffer", "CampaignId", L.LOGIC, ["S.CampId > 0"], ["THEN 99", "StaffFlag"]),
    ("EDWDM.SAL.vOffer", "CampId", L.PLAIN, ["o.CampNk AS CampId", "S.CampId AS CampNk", "Kaynak: edwstg.crm.ofr_offer"], ["CK.CampaignId"]),
    ("EDWDM.SAL.vOffer", "Tries", L.PLAIN, ["Kaynak: edwstg.crm.ofr_offer.tries"], ["CASE", "Written"]),
    ("EDWDM.SAL.vOffer", "StaffFlag", L.LOGIC, ["K.PersonId IS NOT NULL", "EDWUTIL.DTG.KeyPerson"], []),
    ("EDWDM.SAL.vReach", "Whole15", L.LOGIC, ["DATEADD(DAY,-15", "'6','10'", "DATEADD(YEAR,-2"], []),
    ("EDWDM.SAL.vReach", "Reach15", L.LOGIC, ["Whole15 > 0", "'6','10'"], []),
    ("EDWDM.TRE.vHabit", "HabitValue", L.LOGIC, ["1 AS HabitValue"], []),
    ("EDWDM.TRE.vHabit", "HabitId", L.LOGIC, ["9: leaving (About to leave)"], []),
    ("EDWDM.SAL.vTop", "Sign", L.LOGIC, ["'Var'"], []),
    ("Bridge.AIS.rpt_Group", "Total", L.LOGIC, ["SUM(P.Items)"], []),
    ("Bridge.AIS.odd", "Level", L.UNKNOWN, ["EXEC other @Level = 3 -- Level matters"], []),
    ("Bridge.AIS.none", "Level", L.UNKNOWN, [], []),
]


@pytest.mark.parametrize(("key", "column", "kind", "there", "absent"), CASES)
def test_evidence(code, key, column, kind, there, absent):
    found, steps = L.column_evidence(code, key, column)
    text = " ".join(steps)
    assert found == kind, steps
    assert all(x in text for x in there) and not any(x in text for x in absent), steps
    assert sum(map(len, steps)) <= L.LONGEST


def test_scope(code):
    assert any("Written" in part for part in L.object_scope(code, "EDWDM.SAL.vOffer"))
    assert L.object_scope(code, "EDWDM.SAL.vTop") == ["2 kolu olan UNION"]
    assert L.object_scope(code, "none") == []


def test_sign_rules_and_bare_columns():
    narrowed = LOAD.replace("= OK.OfferNk;", "= OK.OfferNk LEFT JOIN EDWKEY.SAL.Crm CC ON CAST(S.CampId * -1 AS VARCHAR(50)) = CC.Nk AND S.CampId < 0 AND CC.EdwSourceTable = 'Camp';")
    kind, steps = L.column_evidence(L.Code.build({"EDWDM.SAL.vOffer": VIEW, "EDWLRY.SAL.ins_Offer": narrowed}), "EDWDM.SAL.vOffer", "CampId")
    assert kind == L.LOGIC and "S.CampId < 0" in " ".join(steps) and "EdwSourceTable" not in " ".join(steps)
    view = "CREATE VIEW [OTH].[vRisk] AS SELECT [Period], [Risk], I.Nk AS Masked FROM [OTH].[Risk] AS M WITH(NOLOCK) LEFT JOIN EDWUTIL.[DTG].[KeyId] AS I WITH(NOLOCK) ON I.Nk = M.TaxNumber;"
    load = """CREATE PROCEDURE [OTH].[ins_Risk] AS BEGIN
INSERT INTO #Got WITH(TABLOCK) (TaxNumber, [Risk])
SELECT R.TaxNumber, ISNULL(SUM(R.Short + R.Long), 0) AS [Risk] FROM [EDW].[OTH].[Limit] AS R GROUP BY R.TaxNumber;
INSERT INTO [OTH].[Risk] ([TaxNumber], [Risk]) SELECT R.TaxNumber, SUM(ISNULL(R.[Risk], 0)) AS [Risk] FROM #Got AS R GROUP BY R.TaxNumber;
END;"""
    kind, steps = L.column_evidence(L.Code.build({"EDWDM.OTH.vRisk": view, "EDWDM.OTH.ins_Risk": load}), "EDWDM.OTH.vRisk", "Risk")
    assert kind == L.LOGIC and "R.Short + R.Long" in " ".join(steps)


def test_frames(spark, code):
    frame = spark.createDataFrame([*DEFINITIONS.items()], "key string, body string")
    wanted = spark.createDataFrame([(k, c) for k, c, *_ in CASES], "object_key string, column_name string").repartition(3)
    got = {(r.object_key, r.column_name): (r.kind, r.steps) for r in L.evidence(frame, wanted).collect()}
    assert got == {(k, c): L.column_evidence(code, k, c) for k, c, *_ in CASES}
    assert sorted({r.table for r in L.writes(frame).collect()}) == ["#goods", "#leaving", "edwdm.tre.habit", "edwlry.sal.offer"]


def test_scope_plan(spark):
    frame = spark.createDataFrame([*DEFINITIONS.items()], "key string, body string")
    rows = spark.createDataFrame([("EDWDM.TRE.vHabit", "HabitValue", False, False), ("EDWDM.TRE.vHabit", "HabitId", False, False), ("EDWDM.SAL.vBase", "Sign", True, True), ("EDWDM.SAL.vTop", "Sign", False, False)], "object_key string, column_name string, table_is_new boolean, is_new boolean")
    none = spark.createDataFrame([], "object_key string, column_name string, digest string")
    first = {(r.object_key, r.column_name): r for r in L.plan_scope(frame, rows, none).collect()}
    assert {k: r.reason for k, r in first.items() if r.reason} == {("EDWDM.SAL.vBase", "Sign"): "new_table"}
    trail = L.evidence(frame, rows).select("object_key", "column_name", L.trail_digest(*map(__import__("pyspark").sql.functions.col, ("steps", "scope"))).alias("digest"))
    gates = spark.createDataFrame([(r.object_key, "", r.gate) for r in first.values()], "object_key string, column_name string, digest string").distinct()
    stored = trail.unionByName(gates)
    changed = spark.createDataFrame([(k, v.replace("9 HabitId", "8 HabitId")) for k, v in DEFINITIONS.items()], "key string, body string")
    plan = L.plan_scope(changed, rows.withColumn("table_is_new", __import__("pyspark").sql.functions.lit(False)).withColumn("is_new", __import__("pyspark").sql.functions.lit(False)), stored)
    assert [(r.object_key, r.column_name) for r in plan.where("reason = 'code'").collect()] == [("EDWDM.TRE.vHabit", "HabitId")]
    kept = {(r.object_key, r.column_name): r.digest for r in L.kept_digests(plan, stored, none.select("object_key", "column_name")).collect()}
    old = {(r.object_key, r.column_name): r.digest for r in stored.collect()}
    assert kept == old  # what wasn't answered stays as it was
    answered = {(r.object_key, r.column_name): r.digest for r in L.kept_digests(plan, stored, plan.where("reason = 'code'")).collect()}
    assert {k for k in old if answered[k] != old[k]} == {("EDWDM.TRE.vHabit", "HabitId"), ("EDWDM.TRE.vHabit", "")}
