"""Dictionary matches against a plain reading of the rules."""

import random
import re

import pytest
from pyspark.sql import functions as F

from corvane.operators import dictionary as D
from corvane.queries import QUERIES
from tests.conftest import DATA


def brute(text, terms):
    """Longest match from the left by trying every term at every token."""
    text = text or ""
    tokens = [m.span() for m in re.finditer(D.TOKEN, text)]
    known = {" ".join(t.lower().split()): t for t in sorted((t for t in terms if t and t.strip()), reverse=True)}
    longest = max((len(re.findall(D.TOKEN, t)) for t in known), default=0)
    out, i = [], 0
    while i < len(tokens):
        for j in range(min(i + longest, len(tokens)), i, -1):
            a, b = tokens[i][0], tokens[j - 1][1]
            if (run := " ".join(text[a:b].lower().split())) in known:
                out.append((a, b, known[run]))
                i = j
                break
        else:
            i += 1
    pieces = [text[x:y] for x, y in zip([0, *[b for _, b, _ in out]], [*[a for a, _, _ in out], len(text)], strict=True)]
    return out, " ".join(" ".join(pieces).split())


def check(spark, texts, terms):
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    known = spark.createDataFrame([(t,) for t in terms], "w string")
    found = {}
    for r in D.find_terms(df, "k", "t", known, "w").collect():
        found.setdefault(r["k"], []).append((r["start"], r["end"], r["term"]))
    rest = {r["k"]: r for r in D.matched_and_rest(df.repartition(3), "k", "t", known, "w").collect()}
    assert len(rest) == len(texts)
    for k, t in enumerate(texts):
        spans, left = brute(t, terms)
        assert sorted(found.get(k, [])) == spans
        assert rest[k]["remainder"] == left and rest[k]["terms"] == sorted({s[2] for s in spans}) and rest[k]["n_matches"] == len(spans)


def test_whole_words_and_signs(spark):
    terms = ["Java", "JavaScript", "C", "C++", "c#", ".NET", "node.js", "Machine Learning", "machine learning engineer", "learning", "", None, " ", "AT&T", "Ünïx", "java"]
    texts = ["java javascript JAVA,c++ and C# .net", "Machine\n\tlearning engineers; machine  learning engineer", "node.js nodejs node .js AT&T at & t", "unix ünïx ÜNÏX", None, "", "   ", "C++++ C + +", "learning machine learning learning"]
    check(spark, texts, terms)


@pytest.mark.parametrize("seed", range(3))
def test_random_texts(spark, seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "b", "ab", "é", "日本", "x1"])
    terms = list({rng.choice(["", "."]).join([rng.choice(["", " "]).join(word() + rng.choice(["", "+", " "]) for _ in range(rng.randint(1, 4)))]) for _ in range(40)})
    texts = ["".join(word() + rng.choice([" ", "  ", "+", ".", "", "\n"]) for _ in range(rng.randint(0, 60))) for _ in range(40)]
    check(spark, texts, terms)


def test_long_text_repeats_and_empty_dictionary(spark):
    check(spark, ["spark sql " * 5000, "sql"], ["spark sql", "sql spark sql"])
    check(spark, ["spark sql", None], [])
    df = spark.createDataFrame([(1, "sql sql")] * 2, "k int, t string")
    assert D.find_terms(df, "k", "t", spark.createDataFrame([("sql",)] * 3, "w string"), "w").count() <= 4
    assert D.find_terms(df.limit(0), "k", "t", spark.createDataFrame([("sql",)], "w string"), "w").count() == 0


def test_dictionary_of_thousands(spark):
    """The registered query: thousands of terms over whole documents, equal to the plain reading."""
    rows = {r["doc_id"]: r for r in QUERIES["dictionary_terms"](spark, DATA).collect()}
    from corvane.queries.extracts import phrases

    terms = [r["term"] for r in phrases(spark.read.parquet(f"{DATA}/benchmark.parquet")).collect()]
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert len(terms) > 1000 and set(rows) == set(docs)
    import hashlib

    hit = 0
    for k in sorted(docs)[:60]:
        if len(docs[k] or "") > 4000:
            continue
        spans, left = brute(docs[k], terms)
        hit += len(spans)
        assert (rows[k]["n_matches"], rows[k]["n_terms"], rows[k]["remainder_md5"]) == (len(spans), len({s[2] for s in spans}), hashlib.md5(left.encode()).hexdigest())
    assert hit > 50


def test_bitmap_is_bounded(spark):
    longest, bits = D._bitmap(spark.range(30_000).select(F.concat(F.lit("w"), F.col("id").cast("string")).alias("run")))
    assert longest == 1 and len(bits) == D._BITS // 8
