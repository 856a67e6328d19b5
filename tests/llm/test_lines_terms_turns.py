"""Line dedup, source divergence and conversation repair against SQL and brute force, with awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import pairwise

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvane.llm import conversation_repair as cr
from corvane.llm import divergence, line_dedup
from corvane.llm.queries import QUERIES
from tests.conftest import DATA
from tests.test_queries import rows as shown

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ("h1", "h2", "mark", "gone", "last", "pos", "n", "own", "v", "term", "blk_p", "total", "k1", "r1", "symbol", "audit", "there")


def clashing(df):
    return df.withColumns({c: F.lit("clash") for c in CLASH})


def same_as_sql(spark, df, sql, got):
    import pandas as pd

    con = duckdb.connect()
    con.register("given", pd.DataFrame([r.asDict() for r in df.collect()], columns=df.columns).astype("object"))
    kinds = {"bigint": "BIGINT", "string": "VARCHAR"}
    con.execute("CREATE TABLE documents AS SELECT " + ", ".join(f"{c}::{kinds[k]} AS {c}" for c, k in df.dtypes) + " FROM given")
    want = con.execute(sql)
    assert shown(got.columns, got.collect()) == shown([d[0] for d in want.description], want.fetchall())


def line_query(df, **a):
    return line_dedup.remove_lines(df, **a).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def messy_lines(spark):
    long = "\n".join(f"line number {i % 700} of a very long text" for i in range(20000))
    shared = "A Line That Everyone Has, Ünïcode too"
    rows = [(1, None), (2, ""), (3, "\n\n"), (4, long), (5, long), (6, long), (7, f"x\n \ta line THAT everyone has, Ünïcode TOO\r\ny\n{shared}"), (8, shared), (9, shared + "\n" + shared), (9, shared), (None, shared + "\nz"), (None, shared), (10, "exactly nineteen ch\nÄÖÜ exactly twenty c"), (11, "exactly nineteen ch\nÄÖÜ exactly twenty c"), (12, "exactly nineteen ch\nÄÖÜ exactly twenty c\näÖÜ exactly twenty c"), (12, "exactly nineteen ch")]
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)


def test_lines_match_sql(spark):
    df = messy_lines(spark)
    same_as_sql(spark, df, line_dedup.oracle(), line_query(clashing(df)))


def test_lines_by_rule(spark):
    got = {(r["doc_id"], r["n_lines"]): r["text"] for r in line_dedup.remove_lines(messy_lines(spark)).collect()}
    assert got[(7, 4)] == "x\ny" and got[(8, 1)] == "" and got[(9, 2)].count("A Line") == 2 and got[(None, 2)] == "z"
    assert got[(10, 2)] == "exactly nineteen ch" and got[(6, 20000)].count("\n") == 19999 and got[(4, 20000)] == ""


def test_lines_of_rows_without_id(spark):
    """Rows without an id are one document: alone they repeat nothing, and they are the smallest."""
    text = "the same long line in many rows"
    df = spark.createDataFrame([(None, text)] * 5 + [(1, text)], "doc_id long, text string")
    assert {r["n_dropped"] for r in line_dedup.remove_lines(df).collect()} == {0}
    assert sorted(r["n_dropped"] for r in line_dedup.remove_lines(df, documents=2).collect()) == [0, 1, 1, 1, 1, 1]


def test_lines_empty_table_and_string_ids(spark):
    assert line_dedup.remove_lines(spark.createDataFrame([], DOCS)).count() == 0
    df = spark.createDataFrame([(i, "one line that is long enough") for i in "abc"], "doc_id string, text string")
    assert {r["doc_id"]: r["n_dropped"] for r in line_dedup.remove_lines(df).collect()} == {"a": 1, "b": 1, "c": 0}


@pytest.mark.parametrize("name", ["op11_source_divergence", "op12_line_dedup"])
def test_queries_match_sql(spark, name):
    from corvane.llm.queries import ORACLE

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{DATA}/documents.parquet')")
    want = con.execute(ORACLE[name])
    got = QUERIES[name](spark, DATA)
    assert shown(got.columns, got.collect()) == shown([d[0] for d in want.description], want.fetchall())


# divergence


def messy_terms(spark):
    rng = random.Random(3)
    words = ["Über", "über", "the", "The", "a1b", "日本", "x_y", "rare", "mid-way", "😀smile"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(30))) if i % 9 else None, rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "é", None, "Z"]), 0) for i in range(120)]
    rows += [(500, "only one", "xx", "alone", 0), (501, None, "yy", "p", 0), (502, "", "yy", "q", 0), (500, "the " * 70000, "en", "huge", 0), (None, "the a", "en", "s1", 0)]
    return spark.createDataFrame(rows, DOCS)


@pytest.mark.parametrize(("documents", "top"), [(1, 50), (5, 2), (30, 50)])
def test_divergence_matches_sql(spark, documents, top):
    df = messy_terms(spark)
    same_as_sql(spark, df, divergence.oracle(documents, top), divergence.audit(clashing(df), documents, top))


def test_divergence_by_hand(spark):
    df = spark.createDataFrame([(1, "a a b", "l", "x", 0), (2, "b c", "l", "y", 0), (3, "b", "l", "z", 0)], DOCS)
    got = {(r["source"], r["part"], r["item"]): r["value"] for r in divergence.audit(df, 1).collect()}
    p = lambda c, n: 1 + 10**9 * (c + 5) // (n + 15)
    assert got[("x", "pair", "y")] == got[("y", "pair", "x")] == abs(p(2, 3) - p(0, 2)) + abs(p(1, 3) - p(1, 2)) + abs(p(0, 3) - p(1, 2))
    assert got[("x", "term", "a")] == p(2, 3) - p(2, 6) and ("x", "term", "c") not in got


def test_divergence_blocks_hold_every_cell(spark):
    """Narrow blocks of sources give the same joint histograms as one block, and their cells add up to the kept terms."""
    df = messy_terms(spark)
    whole, cut = divergence.Audit(df, 3), divergence.Audit(df, 3, width=2)
    order = ["lang", "a", "b", "x", "y"]
    a, b = whole.histograms().orderBy(order).collect(), cut.histograms().orderBy(order).collect()
    assert a == b
    cells = defaultdict(int)
    for r in a:
        cells[r["lang"], r["a"], r["b"], r["v"]] += r["m"] or 0
    assert all(m == v for (_, _, _, v), m in cells.items())


def test_divergence_of_large_counts(spark):
    """Shares stay exact beyond 64 bits."""
    df = spark.createDataFrame([(9_000_000_000_000_000, 123_456, 10**16)], "c long, k long, t long")
    got = df.select(divergence._share(F.col("c"), F.col("t"), F.col("k")).alias("p")).first()["p"]
    assert got == 1 + 10**9 * (9_000_000_000_000_000 + 5) // (10**16 + 5 * 123_456)


def test_divergence_empty_table(spark):
    assert divergence.audit(spark.createDataFrame([], DOCS)).count() == 0


# conversations


def cheapest(symbols):
    """Brute force: all-costs search over (row, state) that keeps the least (cost, letters)."""
    n, best = len(symbols), {}

    def least(i, q, room):
        """The least (cost, letters) from here with at most ``room`` inserts before the next row."""
        if (i, q, room) in best:
            return best[i, q, room]
        found = [(0, "")] if i == n and q in (0, 3) else []
        if room:
            to = cr.STEP[cr.NEXT[q]][q]
            c, s = least(i, to, room - 1)
            found.append((c + 2, "I" + s))
        if i < n:
            x = symbols[i]
            c, s = least(i + 1, q, 3)
            found.append((c + 3, "D" + s))
            if x < 8:
                for letter, cost, to in [("K", 0, cr.STEP.get("suax"[x >> 1], (-1,) * 4)[q]), *[("R", 2, cr.STEP[r][q]) for r in "ua"]]:
                    if to >= 0:
                        c, s = least(i + 1, to, 3)
                        found.append((c + cost + (x & 1), letter + s))
        best[i, q, room] = min(found, default=(10**9, ""))
        return best[i, q, room]

    return least(0, 0, 3)


@settings(max_examples=600, deadline=None)
@given(st.lists(st.integers(0, 8), max_size=9))
def test_automaton_equals_brute_force(symbols):
    assert cr.Automaton().repair(bytes(symbols)) == cheapest(symbols)


def test_automaton_stays_small():
    a = cr.Automaton()
    rng = random.Random(1)
    cost, letters = a.repair(bytes(rng.choices(range(9), k=200_000)))
    assert len(a.vectors) < 100 and cost > 0 and len(letters) >= 200_000


def brute(rows):
    """The contract, read plainly; rows of (conv_id, turn, role, text)."""
    out, by = {}, defaultdict(list)
    for c, turn, role, text in rows:
        text, role = " " if text is None else text, " " if role is None else role
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        by[c]
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub(r"[.!?]", "", text) if kind == 2 else text
        by[c] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    for c, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        seen, symbols, count = set(), [], Counter()
        for _, role, text in own:
            place = "sua".find(role[:1]) if role else 3
            place = 3 if place < 0 else place
            bare = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            count[fault] += 1
            symbols.append(8 if fault in ("blank", "duplicate") else 2 * place + (fault == "truncated"))
        turns = [t for t, _, _ in own if t is not None]
        cost, letters = cheapest(symbols)
        lines, expect, it = [], "user", iter(own)
        for e in letters:
            if e == "I":
                lines.append(f"{expect}:")
            else:
                _, role, text = next(it)
                if e == "D":
                    continue
                role = role if e == "K" else expect
                lines.append(f"{role}:{text}")
                if role[0] == "s":
                    continue
            expect = "assistant" if expect == "user" else "user"
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in pairwise(own))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[c] = (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, letters, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def check_repair(df):
    got = cr.repair(cr.damage(clashing(df))).collect()
    mine = {r[0]: tuple(r[1:]) for r in got}
    assert len(mine) == len(got) and mine == brute([(r["conv_id"], r["turn"], r["role"], r["text"]) for r in df.select("conv_id", "turn", "role", "text").collect()])


TALK = "conv_id long, turn long, role string, text string"


def test_repair_of_the_table(spark):
    check_repair(spark.read.parquet(f"{DATA}/conversations.parquet"))


@pytest.mark.parametrize("seed", range(3))
def test_repair_of_messy_rows(spark, seed):
    rng = random.Random(seed)
    roles, texts = ["user", "assistant", "system", "tool", "", None, "User", "student"], ["Hi.", "Hi", "No?  \n", " \t", "", None, "Why! so", "Même…", "Ok."]
    rows = [(c, t, rng.choice(roles), rng.choice(texts)) for c in [*range(60), None, -5] for t in sorted(rng.sample(range(-3, 40), rng.randrange(12)))]
    rows += [(1000, None, "user", "Hi."), (1000, None, "user", "Hi."), (1000, 7, "assistant", "Yes."), (1001, None, "system", None)]
    check_repair(spark.createDataFrame(rows, TALK).repartition(5))


def test_repair_of_ties_and_repeats(spark):
    """Repeated rows are duplicates; rows of one turn have one fixed order, however they are dealt."""
    rows = [(1, 1, "user", "A."), (1, 1, "assistant", "B."), (1, 1, "user", "C.")] * 3
    df = spark.createDataFrame(rows, TALK)
    a, b = (cr.repair(cr.damage(d)).collect() for d in (df.repartition(1), df.orderBy(F.desc("text")).repartition(6)))
    assert a == b and a[0]["duplicate"] == 6 and a[0]["gaps"] == 0


def test_repair_of_long_conversations(spark):
    """Many batches a conversation, and a very long text."""
    rng = random.Random(9)
    rows = [(c, t, ["user", "assistant"][(t + (t % 53 == 0)) % 2], f"Text {t}{rng.choice(['.', ''])}") for c in range(2) for t in range(7000)] + [(5, 0, "user", "long " * 400_000 + "end.")]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    try:
        got = {r["conv_id"]: r for r in cr.repair(cr.damage(spark.createDataFrame(rows, TALK))).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert set(got) == {0, 1, 5} and all(len(got[c]["audit"]) > 6000 and got[c]["gaps"] > 200 for c in (0, 1))
    for c in (0, 1):
        damaged = [(r["turn"], r["role"], r["text"]) for r in cr.damage(spark.createDataFrame([r for r in rows if r[0] == c], TALK)).filter("there").collect()]
        assert sum(e != "I" for e in got[c]["audit"]) == len(damaged)


def test_repair_of_string_ids_and_empty_table(spark):
    df = spark.createDataFrame([("a", 1, "user", "Q?"), ("a", 2, "assistant", "A."), ("b", None, None, None)], "conv_id string, turn int, role string, text string")
    check_repair(df)
    assert cr.repair(cr.damage(spark.createDataFrame([], TALK))).count() == 0


def test_repaired_rows(spark):
    """The operator's own output: the repaired rows themselves, with their edits."""
    rows = spark.createDataFrame([(1, 0, "assistant", "A."), (1, 1, "tool", "T."), (1, 2, "assistant", "B.")], TALK).withColumn("there", F.lit(True))
    found = cr.audits(rows)
    got = [(r["edit"], r["role"], r["text"]) for r in cr.repaired(rows, found).orderBy("place").collect()]
    assert got == [("I", "user", ""), ("K", "assistant", "A."), ("R", "user", "T."), ("K", "assistant", "B.")]
