"""Names against lists by brute force, entity checks, records read from odd lines."""

import random

from pyspark.sql import functions as F

from corvane.functions import lists as L
from corvane.operators import histories as H
from corvane.operators import people as P
from corvane.operators import resumes as R


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_fuzzy_match_misses_nothing(spark):
    r = random.Random(3)
    known = sorted({"".join(r.choice("abc ") for _ in range(r.randint(1, 14))).strip() or "a" for _ in range(60)})
    asked = sorted({"".join(c if r.random() > 0.15 else r.choice("abcd") for c in k) + r.choice(["", "x", "ab"]) for k in known for _ in range(2)} | {"", "  "})
    flat = lambda s: " ".join(s.lower().split())
    for least in (0.85, 0.7, 0.55):
        a, b = spark.createDataFrame([(x,) for x in asked], "n string"), spark.createDataFrame([(x,) for x in known], "k string")
        got = {x["n"]: (x["match"], round(x["score"], 9)) for x in P.fuzzy_match(a, "n", b, "k", least).collect()}
        want = {}
        for n in asked:
            if not n.strip():
                continue
            best = min(((-(1 - distance(flat(n), flat(k)) / max(len(flat(n)), len(flat(k)))), k) for k in known), default=None)
            if -best[0] >= least:
                want[n] = (best[1], round(-best[0], 9))
        assert got == want and len(want) > 20


def test_check_roles(spark):
    rows = spark.createDataFrame([(x,) for x in (None, "", "S", "Coding", "Data Engineer", "Data Enginer", "Tea Maker", "tea maker", "Office boss", "boss of developers")], "t string")
    known = spark.createDataFrame([("Data Engineer",), ("Clerk",)], "t string")
    got = {r["t"]: (r["valid"], r["corrected"], r["reason"]) for r in P.check_entities(rows, "t", known, "t", "role", ["coding"]).collect()}
    assert got == {
        None: (False, "", "empty"), "": (False, "", "empty"), "S": (False, "", "invalid_format"), "Coding": (False, "", "banned_word"), "Data Engineer": (True, "Data Engineer", "exact_match"),
        "Data Enginer": (True, "Data Engineer", "fuzzy_match"), "Tea Maker": (True, "Tea Maker", "multi_word_capitalized"), "tea maker": (False, "", "no_match"), "Office boss": (True, "Office boss", "multi_word_capitalized"),
        "boss of developers": (True, "boss of developers", "heuristic_match"),
    }


def test_records_of_odd_lines(spark):
    text = "Clerk at Shop (Jan 2019 - Mar 2020)\nno dates\n2001 - 2002\nBaker | Mill | 05/2010 to Present\n"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "k int, t string")
    got = sorted((r["k"], r["place"], r["title"], r["company"], str(r["start"]), str(r["end"]), r["current"]) for r in H.experience_records(df, "k", "t", "2024-01-01").collect() if r["title"])
    assert got == [(1, 0, "Clerk", "Shop", "2019-01-01", "2020-03-01", False), (1, 3, "Baker", "Mill", "2010-05-01", "2024-01-01", True)]


def test_number_of_a_firm_is_no_start(spark):
    """A number like a year before a span of dates belongs to the name; two dates with a blank between are a span still."""
    text = "Clerk @ Harbour 2042  1986 - 1988\n\n\nClerk @ Harbour 1999  2001 till date\n\n\nBaker @ Mill  2001  2003\n"
    got = [(r["company"], str(r["start"]), str(r["end"]), r["current"]) for r in H.experience_records(spark.createDataFrame([(1, text)], "k int, t string"), "k", "t", "2024-01-01").orderBy("place").collect()]
    assert got == [("Harbour 2042", "1986-01-01", "1988-01-01", False), ("Harbour 1999", "2001-01-01", "2024-01-01", True), ("Mill", "2001-01-01", "2003-01-01", False)]


def test_records_are_numbered_within_their_text(spark):
    """Numbers come from the text itself, so that rows of one key keep theirs apart and no row moves to be numbered."""
    text = "Clerk at Shop (Jan 2019 - Mar 2020)\n- sold\nBaker | Mill | 05/2010 to Present\n\n\nDriver, Nova Bank, Mar’98 – till now"
    out = H.experience_records(spark.createDataFrame([(1, text), (1, "Baker | Mill | 2001 - 2002"), (2, None)], "k int, t string"), "k", "t", "2024-01-01")
    got = sorted((r["nth"], r["title"], r["company"], str(r["start"]), str(r["end"]), r["current"], r["details"]) for r in out.collect())
    assert got == [
        (1, "Baker", "Mill", "2001-01-01", "2002-01-01", False, []), (1, "Clerk", "Shop", "2019-01-01", "2020-03-01", False, ["sold"]), (2, "Baker", "Mill", "2010-05-01", "2024-01-01", True, []),
        (3, "Driver", "Nova Bank", "1998-03-01", "2024-01-01", True, []),
    ]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


def test_items_with_digits_are_trimmed_of_blanks_only(spark):
    df = spark.createDataFrame([("0 at first. 1 then 1. 2 last 2",)], "t string")
    assert df.select(R.sentences(F.col("t"))).first()[0] == ["0 at first.", "1 then 1.", "2 last 2"]


def test_lenient_lists(spark):
    df = spark.createDataFrame([('["a", "b"]',), ("plain",), ("",), (None,), ("{}",)], "t string")
    assert [r[0] for r in df.select(L.json_list(F.col("t"))).collect()] == [["a", "b"], ["plain"], [], [], ["{}"]]
