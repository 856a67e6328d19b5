"""Job descriptions, pay, levels, certificates, telephone numbers and education: odd texts."""

import pytest
from pyspark.sql import functions as F

from corvane.functions import strings as S
from corvane.operators import histories as H
from corvane.operators import matching as M
from corvane.operators import people as P
from corvane.operators import postings as J
from corvane.operators import schooling as E


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("pays $90k-$120k", (90000.0, 120000.0, "USD", "year", 90000.0)), ("€ 1,500.50 per month", (1500.5, 1500.5, "EUR", "month", 18006.0)), ("12 - 18 LPA", (1200000.0, 1800000.0, "INR", "year", 1200000.0)),
        ("£35/hour", (35.0, 35.0, "GBP", "hour", 72800.0)), ("40000 per annum", (40000.0, 40000.0, None, "year", 40000.0)), ("USD 120,000 to 100,000", (100000.0, 120000.0, "USD", "year", 100000.0)), ("2 kinds of 5 things", None), ("", None), (None, None),
    ],
)
def test_pay(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(J.pay_of(F.col("t")).alias("p")).first()["p"]
    assert (None if got is None else (got["low"], got["high"], got["currency"], got["period"], got["year_low"])) == want


def test_levels_by_evidence(spark):
    rows = [("Senior Clerk", "a graduate, a graduate", None), (None, "junior junior senior", None), (None, "lead and junior", None), (None, "plain", 9), (None, None, None), ("Clerk", "plain", 1)]
    got = [r[0] for r in spark.createDataFrame(rows, "a string, t string, y int").select(J.level_of(F.col("a"), F.col("t"), F.col("y"))).collect()]
    assert got == ["senior", "junior", "lead", "lead", "mid", "junior"]


def test_postings_of_odd_texts(spark):
    texts = [None, "", "We at Acme Labs are seeking a data engineer with go.", "Title : Night Nurse\nPlace - Oslo\n- lift\n* carry", "x " * 60000 + "hiring an Accountant"]
    got = J.read_postings(spark.createDataFrame(list(enumerate(texts)), "k int, t string"), "k", "t").orderBy("k").collect()
    assert [(r["title"], r["company"], r["location"]) for r in got] == [(None, None, None), (None, None, None), ("data engineer", "Acme Labs", None), ("Night Nurse", None, "Oslo"), ("Accountant", None, None)]
    assert got[3]["duties"] == ["lift", "carry"] and got[1]["level"] == "mid" and got[1]["pay"] is None


def test_searches_say_nothing(spark):
    df = spark.createDataFrame([(1, None, None, None, None, None, None), (2, "clerk", ["SQL", "Cobol"], 2.0, None, ["Rome"], " ")], "k int, role string, skills array<string>, min_years double, max_years double, locations array<string>, degree string")
    got = J.searched_postings(df, "k", ["sql"]).orderBy("k").collect()
    assert (got[0]["text"], got[0]["skills"], got[0]["low"], got[0]["location"]) == ("", [], None, "")
    assert (got[1]["text"], got[1]["skills"], got[1]["low"], got[1]["high"], got[1]["degree"]) == ("clerk. Skills: SQL, Cobol. 2+ years. Location: Rome", ["sql", "cobol"], 2, None, None)


def test_certificates(spark):
    rows = [("has aws and pmp", ["AWS Pro"], ["aws", "pmp", "cka"]), (None, None, ["aws"]), ("x", None, []), ("x", [], None), ("aws", ["aws", "aws"], ["AWS"])]
    got = [r[0] for r in spark.createDataFrame(rows, "t string, c array<string>, w array<string>").select(M.certification_score(F.col("t"), F.col("c"), F.col("w"))).collect()]
    assert got == [100.0, 0.0, 100.0, 100.0, 100.0]


def test_phones(spark):
    rows = ["call 555-123-4567 or (555) 123 4567x", "1111111111 and 2024.01.02", "id 1234567890123456789 v1.555.123.45678", "+44 2071 234 567", "", None]
    got = [r[0] for r in spark.createDataFrame([(r,) for r in rows], "t string").select(S.real_phones(F.col("t"))).collect()]
    assert got[0][0] == "555-123-4567" and len(got[0]) == 2 and got[1] == [] and got[2] == [] and got[3] == ["+44 2071 234 567"] and got[4:] == [[], None]


def test_education_over_lines(spark):
    texts = [
        "Education\nB.Tech (CSE)\nIIT Nordwind\n2012-2016\nCGPA: 8.4/10", "Worked as a master of ceremonies at hotel", "MIT\nPh.D in Physics | 2001\n\n\n3.9 gpa\nMBA, Some University, 75%", None, "",
        "Be there at 9.\nBE\nSt. Mary College (2009)\nM.A. in Art, grade 4.5", "Diploma\n" + "x" * 400, "Bachelor of Arts\nBachelor of Arts",
    ]
    got = {}
    for r in E.education_records(spark.createDataFrame(list(enumerate(texts)), "k int, t string"), "k", "t").collect():
        got.setdefault(r["k"], []).append((r["degree"], r["field"], r["institution"], r["start_year"], r["end_year"], r["gpa"], r["scale"]))
    assert got == {
        0: [("B.Tech", "CSE", "IIT Nordwind", 2012, 2016, 8.4, 10.0)], 2: [("Ph.D", "Physics", "MIT", None, 2001, None, None), ("MBA", None, "Some University", None, None, 75.0, 100.0)],
        5: [("BE", None, "St. Mary College", None, 2009, None, None), ("M.A.", "Art", None, None, None, 4.5, 5.0)], 6: [("Diploma", None, None, None, None, None, None)],
        7: [("Bachelor of Arts", None, None, None, None, None, None)] * 2,
    }


def test_histories_in_ordinary_layouts(spark):
    """The usual layouts, each as one text: title, company, start, current and details."""
    texts = [
        "Software Engineer\nAcme Ltd\nSept 2018 - Mar 2020\n- did a\n• did b\nAnalyst\nBeta Group\nMar'19 – till date\n* c", "Jan. 2019 - Present\nSenior Developer\nHarbour 12\nbuilt many things there.\n02/2016 - 12/2018\nDeveloper @ Nova Systems",
        "Company: Acme\nRole: Clerk\nDuration: since 2017\nResponsibilities:\n- x\nCompany: Nova\nRole: Lead\nDuration: 2012 to 2016", "Manager @ Nordwind  Hamburg  2019  Present\nEnvironment: Java\nDeveloper, Amazon, 2014 - 2016",
        None, "", "Skills\nJava\nEducation\nB.Tech 2012-2016", "Clerk\n" + "\n".join(f"- line {i}" for i in range(3000)), "Clerk | Shop | 2001 - 2002\nClerk | Shop | 2001 - 2002",
    ]
    got = {}
    for r in H.experience_records(spark.createDataFrame(list(enumerate(texts)), "k int, t string"), "k", "t", "2024-01-01").orderBy("k", "place").collect():
        got.setdefault(r["k"], []).append((r["title"], r["company"], str(r["start"])[:7], r["current"], len(r["details"])))
    assert got == {
        0: [("Software Engineer", "Acme Ltd", "2018-09", False, 2), ("Analyst", "Beta Group", "2019-03", True, 1)], 1: [("Senior Developer", "Harbour 12", "2019-01", True, 1), ("Developer", "Nova Systems", "2016-02", False, 0)],
        2: [("Clerk", "Acme", "2017-01", True, 2), ("Lead", "Nova", "2012-01", False, 0)], 3: [("Manager", "Nordwind", "2019-01", True, 1), ("Developer", "Amazon", "2014-01", False, 0)],
        7: [("Clerk", None, "None", False, 3000)], 8: [("Clerk", "Shop", "2001-01", False, 0)] * 2,
    }


def test_stated_years(spark):
    rows = ["5 years of experience", "experience:\t7 yrs", "around ~3.5 years", "12 years", "99 years of work, total 8 years", None, "", "over 2 years; born 30 years ago", "combined 4+ years"]
    got = [r[0] for r in spark.createDataFrame([(r,) for r in rows], "t string").select(P.stated_years(F.col("t"))).collect()]
    assert got == [5.0, 7.0, 3.5, None, 8.0, None, None, 2.0, 4.0]
