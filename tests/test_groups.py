"""Groups over chains, sections by contest, likeness and losses: brute force and awkward rows."""

import random

import pytest
from pyspark.sql import functions as F

from corvane.functions import udfs
from corvane.operators import clusters as C
from corvane.operators import losses as Q
from corvane.operators import sections as S
from corvane.queries import QUERIES
from tests.conftest import DATA


def roots(n, links):
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


@pytest.mark.parametrize("seed", range(3))
def test_connected_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    n = 300
    links = [(rng.randrange(n), rng.randrange(n)) for _ in range(180)] + [(i, i + 1) for i in range(200, 260)] + [(5, 5)]
    got = {r["id"]: r["root"] for r in C.connected(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == {i: r for i, r in enumerate(roots(n, links)) if r != i}


def test_groups_over_chains_and_awkward_rows(spark):
    rows = [(1, "a", "x"), (2, "a", None), (3, None, "x"), (4, "", ""), (5, "", ""), (6, "q", "y"), (7, "r", "y"), (8, "r", "z"), (8, "r", "z"), (None, "a", "x"), (9, None, None)]
    df = spark.createDataFrame(rows, "i long, p string, q string")
    got = {r["i"]: r["group_id"] for r in C.duplicate_groups(df, "i", [F.col("p"), F.col("q")]).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 6, 8: 6, 9: 9}
    assert C.duplicate_groups(df.limit(0), "i", [F.col("p")]).count() == 0


def test_a_key_that_a_third_shares(spark):
    df = spark.range(9000).select(F.col("id").alias("i"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") / 5).cast("int").cast("string"))).alias("p"))
    got = C.duplicate_groups(df, "i", [F.col("p")])
    assert got.filter("group_id = 0").count() == 3000 and got.count() == 9000


def test_children_move_over_chains(spark):
    people = spark.createDataFrame([(1, "A", None), (2, "A", "n2"), (3, "B", "n3")], "i long, p string, name string").withColumn("q", F.when(F.col("i") > 1, "z"))
    groups = C.duplicate_groups(people, "i", [F.col("p"), F.col("q")])
    heads = C.survivors(people, "i", groups, [-F.col("i")])
    assert [tuple(r) for r in C.merged(people, "i", groups, [-F.col("i")], ["name"]).collect()] == [(3, 3, "n3")]
    kids = spark.createDataFrame([(1, "mon", 10), (2, "mon", 11), (2, "tue", 12), (3, "tue", 13)], "i long, day string, o int")
    got = sorted(tuple(r) for r in C.adopted(kids, "i", groups, heads, ["day"], "o").collect())
    assert got == [(3, "mon", 10), (3, "tue", 13)]


def test_sections_of_odd_texts(spark):
    long = "SKILLS\n" + "\n".join(f"skill {i}" for i in range(5000))
    texts = [None, "", "no headings here at all", "EDUCATION\n", "Skills: go and sql and c\nSkills\ngo", long, "Summary\na\nEducation\nb\nSummary\nc", "x\n\nM.Sc Physics\n\nSkills\ngo\n\nB.Sc Biology"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").withColumn("section", F.lit("clash"))
    got = {}
    for r in S.best_sections(df.select("k", "t"), "k", "t").collect():
        got.setdefault(r["k"], {})[r["section"]] = (r["way"], r["text"])
    assert set(got) == {2, 4, 5, 6, 7}
    assert got[2] == {"header": ("position", "no headings here at all")}
    assert got[4]["skills"] == ("pattern", "go") and got[5]["skills"][1].count("\n") == 4999
    assert got[6] == {"summary": ("pattern", "a\nc"), "education": ("pattern", "b")}
    # content does not end a section that a heading opened
    assert got[7] == {"header": ("position", "x"), "education": ("content", "M.Sc Physics"), "skills": ("pattern", "go\nB.Sc Biology")}


def table(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old = row[:]
        for j, y in enumerate(b, 1):
            row[j] = old[j - 1] + 1 if x == y else max(old[j], row[j - 1])
    return row[-1]


def test_common_length_equals_table():
    rng = random.Random(4)
    for _ in range(400):
        a, b = ("".join(rng.choices("abcé", k=rng.randrange(25))) for _ in range(2))
        assert udfs.common_length(a, b) == table(a, b)
    assert udfs.common_length("", "x") == 0 and udfs.common_length("ab" * 20000, "ba" * 20000) == 39999


def test_likeness_of_nulls_and_equals(spark):
    df = spark.createDataFrame([("a b", "a b"), ("", ""), ("abc", ""), (None, "x"), ("abcd", "bd")], "a string, b string")
    assert [r[0] for r in df.select(udfs.likeness("a", "b")).collect()] == [1.0, 1.0, 0.0, None, pytest.approx(4 / 6)]


def test_quality_query_against_plain_reading(spark):
    from corvane.queries.groups import _rebuilt

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = {r["doc_id"]: r for r in QUERIES["extraction_quality"](spark, DATA).collect()}
    both = {r["doc_id"]: (r["text"] or "", r["rebuilt"] or "") for r in _rebuilt(docs).collect()}
    assert set(got) == set(both)
    flat = lambda t: " ".join(t.lower().split())
    some = [k for k, (a, _) in sorted(both.items()) if len(a) < 900][:25]
    for k in some:
        a, b = map(flat, both[k])
        want = 2 * table(a, b) / (len(a) + len(b)) if a or b else 1.0
        assert abs(got[k]["likeness"] - want) < 2e-6 and got[k]["quality"] <= got[k]["likeness"]
    assert len(some) > 10


def test_losses(spark):
    a = "Skills\n• one\n• two\n• three\n• four\n• five\n• six\nmail x@y.org, +49 30 1234567\nJan 2020, Feb 2021 and 2019 - 2020 the zebra\nÜbung"
    df = spark.createDataFrame([(1, a, "one two three", ["Education"]), (2, a, a, ["My Skills"]), (3, None, None, None)], "k int, a string, b string, f array<string>")
    got = {r["k"]: r for r in Q.compare(df, "k", "a", "b", "f").collect()}
    assert got[1]["words"][:2] == ["skills", "zebra", "übung"][:2] and "übung" in got[1]["words"] and "the" not in got[1]["words"] and got[1]["sections"] == ["skills"]
    assert set(got[1]["structure"]) == {"bullets", "dates", "addresses", "phones", "lines"}
    assert (got[2]["quality"], got[2]["words"], got[2]["sections"], got[2]["structure"]) == (1.0, [], [], []) and got[3]["quality"] == 1.0
