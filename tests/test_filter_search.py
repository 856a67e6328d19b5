"""Search by filters: hard stage, score, and the two ways to page."""

import pytest

from corvane.plans.filter_search import Filters, filter_search

SCHEMA = "id int, title string, skills array<string>, years double, location string, degree string, text string, status string, created_at string"
ROWS = [
    (1, "Senior Java Developer", ["Java", "Spark"], 6.0, "Pune", "Master of Science", "java spark streams", None, "2024-01-01"),
    (2, "Java Engineer", ["Java"], 3.0, "pune", "Bachelor", "java and spark", "active", "2024-01-03"),
    (3, "Java Engineer", ["Java", "Spark"], 5.0, "Oslo", "Bachelor", "java", "active", "2024-01-02"),
    (4, "Java Engineer", ["Java", "Spark"], 5.0, "Pune", None, "java", "deleted", "2024-01-04"),
    (5, "Tester", None, 9.0, "Pune", None, None, "active", "2024-01-05"),
]


@pytest.mark.parametrize(("page_first", "want"), [(False, [1, 2]), (True, [2])])
def test_filter_search(spark, page_first, want):
    f = Filters(role="java", skills=["java", "spark"], min_years=3, locations=["Pune"], degree="master")
    got = filter_search(spark.createDataFrame(ROWS, SCHEMA), f, size=1 if page_first else 20, page_first=page_first).collect()
    assert [r["id"] for r in got] == want
    assert all(0 <= r["score"] <= 100 for r in got)


def test_no_filters_and_pages(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    seen = [r["id"] for n in (1, 2, 3) for r in filter_search(df, Filters(), number=n, size=2).collect()]
    assert sorted(seen) == [1, 2, 3, 5]


def test_job_text():
    assert Filters(role="java", skills=["go"], min_years=3, max_years=5).job_text() == "java. Skills: go. 3-5 years"
