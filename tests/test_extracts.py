"""Resume text, matching and the pandas functions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from corvane.functions.udfs import reading_order, sequence_ratio
from corvane.operators import matching, resumes
from corvane.queries import QUERIES
from tests.conftest import DATA

TEXT = "Ann Lee\nann@x.com\n\nSUMMARY\nEngineer.\n\nWork Experience:\nAcme, 2019\nBeta, 2020\n\nEducation\nBSc\n\nSkills\nJava, C++\n\nEXPERIENCE\nGamma, 2022"


def test_sections(spark):
    df = spark.createDataFrame([(1, TEXT), (2, "no headings at all"), (3, None), (4, "")], "id int, text string")
    got = {(r["id"], r["section"]): r["text"] for r in resumes.split_sections(df, "id", "text").collect()}
    assert got == {
        (1, "header"): "Ann Lee\nann@x.com", (1, "summary"): "Engineer.", (1, "experience"): "Acme, 2019\nBeta, 2020\nGamma, 2022", (1, "education"): "BSc", (1, "skills"): "Java, C++",
        (2, "header"): "no headings at all",
    }


@pytest.mark.parametrize(("text", "want"), [("3-5 years", (3, 5)), ("5+ years", (5, None)), ("2 years", (1, 2)), ("2 to 4 years of it", (2, 4)), ("none", (None, None))])
def test_experience_asked(spark, text, want):
    r = spark.range(1).select(resumes.experience_asked(F.lit(text)).alias("e")).first()["e"]
    assert (r["low"], r["high"]) == want


def test_job(spark):
    df = spark.createDataFrame([(1, "Need Java and C++. 3-5 years, Bachelor, certified")], "id int, text string")
    r = resumes.extract_job(df, "id", "text", ["java", "c++", "go"]).first()
    assert (r["skills"], r["low"], r["high"], r["degree"], r["certified"]) == (["java", "c++"], 3, 5, "bachelor", True)
    assert df.select(resumes.without_skills(F.lit("use Java, C++ and Javascript"), ["java", "c++"])).first()[0] == "use , and Javascript"


def test_positions_and_offsets(spark):
    df = spark.createDataFrame([("ab ab  abab", "ab"), ("x", "ab"), ("a.b", "."), ("x", "")], "t string, v string")
    assert [r[0] for r in df.select(resumes.positions(F.col("t"), F.col("v"))).collect()] == [[0, 3, 7, 9], [], [1], []]
    rows = resumes.tokens_with_offsets(spark.createDataFrame([(1, " ab  c\nd")], "k int, t string"), "k", "t").orderBy("pos").collect()
    assert [(r["token"], r["start"], r["end"]) for r in rows] == [("ab", 1, 3), ("c", 5, 6), ("d", 7, 8)]


def test_section_fit(spark):
    counts = spark.createDataFrame([(1, "DATE", 4), (1, "ORG", 3), (2, "DEGREE", 2)], "k int, type string, n int")
    prints = spark.createDataFrame([("experience", "DATE", 2, 99), ("experience", "ORG", 1, 99), ("education", "DEGREE", 1, 9), ("education", "ORG", 0, 2)], "section string, type string, low int, high int")
    assert {r["k"]: (r["section"], r["violations"]) for r in resumes.section_fit(counts, "k", prints).collect()} == {1: ("experience", 0), 2: ("education", 0)}


def test_greedy_assignment(spark):
    pairs = spark.createDataFrame([(1, 1, "a", "x", 0.9), (1, 1, "b", "x", 0.95), (1, 1, "b", "y", 0.7), (2, 1, "a", "z", 0.8)], "candidate int, job int, wanted string, had string, sim double")
    got = sorted(tuple(r) for r in matching.assign(pairs).collect())
    assert got == [(1, 1, "a", "x", 0.9), (1, 1, "b", "y", 0.7), (2, 1, "a", "z", 0.8)]


def test_pandas_functions(spark):
    df = spark.createDataFrame([("abcd", "bcde"), (None, "a")], "a string, b string")
    assert [r[0] for r in df.select(sequence_ratio("a", "b")).collect()] == [0.75, None]
    page = "Left one      Right one\nLeft two      Right two\nLeft six      Right six"
    got = spark.createDataFrame([(page,), ("plain\ntext",), (None,)], "t string").select(reading_order("t")).collect()
    assert [r[0] for r in got] == ["Left one\nLeft two\nLeft six\nRight one\nRight two\nRight six", "plain\ntext", None]


def test_project_and_role_scores(spark):
    r = spark.range(1).select(
        matching.project_score(F.lit(""), ["a"]), matching.project_score(F.lit("x"), []), matching.project_score(F.lit("java and go"), ["java", "go", "c", "rust"]),
        matching.role_score(F.lit("Senior Java Developer"), "java engineer"), matching.role_score(F.lit("java tester"), "java engineer"),
    ).first()
    assert list(r) == [40.0, 50.0, 50.0, 100.0, 30.0]


@pytest.mark.parametrize("name", ["section_fit", "merged_by_policy"])
def test_tables_of_rules_go_to_the_rows(spark, name):
    """No large side is dealt out over the few keys of a table of rules."""
    plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_nearest_within_in_blocks(spark):
    """Against a plain reading, with null, zero, shorter and repeated vectors; a meeting of two blocks is one product, not a row for each pair."""
    rng = random.Random(5)
    vectors = {i: [float(rng.randint(-2, 2)) for _ in range(3 if i % 9 == 4 else 4)] for i in range(90)} | {90: None, 91: [0.0] * 4, 92: [1.0, None, 1.0, 1.0], 93: [1.0] * 4, 94: [1.0] * 4}
    df = spark.createDataFrame([(i, i % 3 if i < 90 else 7, v) for i, v in vectors.items()], "k long, g int, v array<double>")

    def cosine(a, b):
        if a is None or b is None or None in a + b or len(a) != len(b) or not any(a) or not any(b):
            return None
        return round(sum(x * y for x, y in zip(a, b)) / (math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(y * y for y in b))), 9)

    got = matching.nearest_within(df.filter("k % 2 = 0 or k > 90"), df, "k", "g", "v", 4, block=10)
    near = {}
    for r in got.orderBy("k", F.desc("sim"), "other").collect():
        near.setdefault(r["k"], []).append((r["other"], r["sim"]))
    for i in near:
        all_ = [(j, cosine(vectors[i], w)) for j, w in vectors.items() if j != i and (j % 3 if j < 90 else 7) == (i % 3 if i < 90 else 7)]
        assert near[i] == sorted(all_, key=lambda x: (x[1] is None, -(x[1] or 0), x[0]))[:4]
    assert len(near) == 45 + 5
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CoGroups" in plan


@pytest.mark.parametrize("name", ["job_parse", "skills_named", "text_losses"])
def test_small_tables_are_read_by_all_cores(spark, name):
    assert QUERIES[name](spark, DATA).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_skills_bind_the_squeezed_text_once(spark):
    df = spark.createDataFrame([("Go. C++, the  SQL.\n",), (None,), ("",)], "t string").select(resumes.skills_in(F.col("t"), ["sql", "C++", "go", "t"]).alias("s"))
    assert [r[0] for r in df.collect()] == [["sql", "C++", "go"], [], []]
    text = df._jdf.queryExecution().optimizedPlan().toString()
    assert text.index("transform(") < text.index("regexp_replace") < text.index("filter(")


def test_vectors_move_in_their_own_type(spark):
    plan = QUERIES["greedy_assignment"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "array<double>" not in plan
