"""Worked examples of the rules."""

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from corvane.functions import dates, scoring, strings
from corvane.operators import aggregates, records, rows, tagging
from corvane.operators.dedupe import find_duplicates
from corvane.operators.filters import scope
from corvane.plans.boolean_search import SearchError, check, predicate


def one(spark, col, **values):
    return spark.createDataFrame([Row(**{"_": 1} | values)]).select(col.alias("x")).first()["x"]


@pytest.mark.parametrize(("years", "low", "high", "want"), [(2.0, 5.0, None, 40.0), (9.0, 3.0, 7.0, 90.0), (0.0, 10.0, None, 20.0), (30.0, 1.0, 2.0, 75.0), (5.0, 3.0, 7.0, 100.0)])
def test_experience_band(spark, years, low, high, want):
    assert one(spark, scoring.experience_band(F.lit(years), F.lit(low), F.lit(high).cast("double"))) == want


def test_education_gap(spark):
    assert one(spark, scoring.education_gap(F.lit("Bachelor of Science"), F.lit("Master"))) == 75.0
    assert one(spark, scoring.education_gap(F.lit("none"), F.lit("Master"))) == 50.0


def test_labels(spark):
    df = spark.createDataFrame([(80.0,), (65.0,), (50.0,), (49.9,)], "s double")
    assert [r[0] for r in df.select(scoring.engine_label(F.col("s"))).collect()] == ["Strong Match", "Good Match", "Partial Match", "Not Recommended"]


def test_hiring_points(spark):
    df = spark.createDataFrame([(0,), (2,), (5,), (6,)], "n int")
    assert [r[0] for r in df.select(scoring.hiring_jobs_points(F.col("n"))).collect()] == [0, 10, 18, 25]


def test_confidence_weights(spark):
    assert sum(w for _, w in scoring.PARTS) == pytest.approx(1.0)
    assert one(spark, scoring.confidence(**{n: F.lit(1.0) for n, _ in scoring.PARTS})) == 1.0


def test_keys(spark):
    assert one(spark, strings.phone_key(F.lit("+91 98765 43210"))) == "9876543210"
    assert one(spark, strings.phone_key(F.lit("12345"))) is None
    assert one(spark, strings.role_match(F.lit("Senior Java Developer"), F.lit("java engineer")))
    assert not one(spark, strings.role_match(F.lit("manager"), F.lit("project manager")))
    assert one(spark, strings.autocomplete_score(F.lit("Python"), "python")) == 100.0
    assert one(spark, strings.autocomplete_score(F.lit("Python"), "pto")) == 25.0
    assert one(spark, strings.years_of_experience(F.lit("3 years here, 12+ years there, 99 years"))) == 12
    assert one(spark, strings.similarity(F.lit("abc"), F.lit("abd"))) == pytest.approx(2 / 3)


def test_dates(spark):
    assert str(one(spark, dates.parse(F.lit("Jan 2019"), "2024-01-31"))) == "2019-01-01"
    assert str(one(spark, dates.parse(F.lit("present"), "2024-01-31"))) == "2024-01-31"
    assert one(spark, dates.parse(F.lit("1970"), "2024-01-31")) is None
    got = one(spark, dates.range_of(F.lit("Jan 2019 - Present"), "2024-01-31"))
    assert (str(got["start"]), str(got["end"])) == ("2019-01-01", "2024-01-31")


def test_set_scores(spark):
    s = aggregates.set_scores(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c")))
    r = spark.range(1).select(*[c.alias(n) for n, c in s.items()]).first()
    assert (r["precision"], r["recall"], r["f1"]) == (0.5, 0.5, 0.5)


def test_intervals_touch(spark):
    df = spark.createDataFrame([(1, "2020-01-01", "2020-06-01"), (1, "2020-06-01", "2020-12-01"), (1, "2021-01-01", "2021-02-01"), (1, "2021-01-01", "2021-02-01"), (2, None, "2021-01-01")], "k int, s string, e string")
    got = rows.merge_intervals(df, ["k"], "s", "e").orderBy("s").collect()
    assert [(r["s"], r["e"]) for r in got] == [("2020-01-01", "2020-12-01"), ("2021-01-01", "2021-02-01")]


def test_chunks(spark):
    words = F.array(*[F.lit(str(i)) for i in range(10)])
    assert [len(c) for c in one(spark, rows.chunks(words, 4, 3))] == [4, 4, 4]
    assert one(spark, rows.chunks(F.array().cast("array<string>"), 4, 3)) == []


DOCS = [(1, "Java and Spring"), (2, "Go on Android"), (3, "java intern"), (4, None), (5, "100% spark")]


@pytest.mark.parametrize(
    ("q", "want"),
    [("java spring OR go", [1, 2]), ("java NOT intern", [1]), ('"and spring"', [1]), ("Android", [2]), ("(java OR spark) AND NOT spring", [3, 5]), ("100%", [5]), ("100_", []), ("NOT java", [2, 5])],
)
def test_boolean_search(spark, q, want):
    df = spark.createDataFrame(DOCS, "id int, text string")
    assert [r["id"] for r in df.filter(predicate(q, "text")).orderBy("id").collect()] == want


@pytest.mark.parametrize("q", ["", "  ", '"open', "(a", "a)", "AND", "NOT NOT a", "a OR"])
def test_boolean_errors(spark, q):
    with pytest.raises(SearchError):
        predicate(q, "text")
    assert check(q)


def test_tags(spark):
    data = [(1, i, t, g) for i, (t, g) in enumerate([("a", "B-X"), ("b", "I-X"), ("c", "I-Y"), ("d", "O"), ("e", "I-X"), ("f", "B-Y")])]
    df = spark.createDataFrame(data, "sent int, pos int, token string, label string")
    assert sorted(r["token"] for r in tagging.inconsistent(df, "sent", "pos", "label").collect()) == ["c", "e"]
    assert sorted((r["text"], r["type"]) for r in tagging.entities(df, "sent", "pos", "token", "label").collect()) == [("a b", "X"), ("f", "Y")]


def test_span_tags(spark):
    tok = spark.sql("SELECT array(named_struct('start',0,'end',3), named_struct('start',4,'end',7), named_struct('start',8,'end',9)) t, array(named_struct('start',0,'end',7,'type','ROLE')) s")
    assert tok.select(tagging.tag_spans(F.col("t"), F.col("s"))).first()[0] == ["B-ROLE", "I-ROLE", "O"]


def test_validation(spark):
    df = spark.createDataFrame([("a@b.com", "invalid-email", "123456", -5.0, ["Python", "A", "http://example.com"])], "name string, email string, phone string, years double, skills array<string>")
    n, e, p, y = records.valid_name(F.col("name")), records.valid_email(F.col("email")), records.valid_phone(F.col("phone")), records.valid_years(F.col("years"))
    r = df.select(n, e, p, y, records.valid_skills(F.col("skills"))).first()
    assert list(r) == [None, None, None, None, ["Python"]]
    w = df.select(records.warnings([("name", F.col("name"), n), ("email", F.col("email"), e)])).first()[0]
    assert w == ["invalid name", "invalid email"]


def test_duplicates_take_the_strongest_rule(spark):
    old = spark.createDataFrame([(1, "x@a.com", "5551234567"), (2, "y@a.com", "5550000000")], "old int, mail string, phone string")
    new = spark.createDataFrame([(9, "Y@a.com", "555 123 4567"), (8, None, None)], "new int, mail string, phone string")
    keys = [("email", F.lower("mail"), F.lower("mail")), ("phone", strings.phone_key(F.col("phone")), strings.phone_key(F.col("phone")))]
    assert [tuple(r) for r in find_duplicates(new, old, "new", "old", keys).collect()] == [(9, 2, "email")]


def test_scope(spark):
    df = spark.createDataFrame([(1, 10), (2, 11), (3, 12)], "id int, owner int")
    users = spark.createDataFrame([(10, 99), (11, 99), (12, 98)], "id int, team_lead_id int")
    seen = lambda role, user: sorted(r["id"] for r in scope(df, role, user, "owner", users).collect())
    assert (seen("admin", 0), seen("lead", 99), seen("member", 12), seen("guest", 12)) == ([1, 2, 3], [1, 2], [3], [])
