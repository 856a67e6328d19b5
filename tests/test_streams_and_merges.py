"""The job queue as stream and batch, table sinks, merges by policy and windows over tokens."""

import random

import pytest
from pyspark.sql import functions as F

from corvane.operators import survivorship as V
from corvane.operators import windows as W
from corvane.queries import QUERIES
from corvane.sources import sinks
from corvane.streaming import jobs as J
from tests.conftest import DATA

EVENTS = "event_id long, ts timestamp, user_id long, event_type string"
KINDS = {"view": "queued", "error": "failed", "purchase": "done"}


def at(second):
    from datetime import datetime, timedelta

    return datetime(2024, 1, 1) + timedelta(seconds=second)


def plain(events, until):
    """The queue by a list of pending timers, second by second of its events."""
    out = []
    for job in sorted({e[2] for e in events if e[2] is not None}):
        status, n, timer = "", 0, None
        mine = sorted((e[1], e[0], e[3]) for e in events if e[2] == job and e[3] in KINDS and e[1] is not None)
        for t, _, kind in [*mine, (until, 0, None)]:
            while timer is not None and timer <= t:
                if status == "delayed":
                    out.append((job, timer, "due", n))
                    status, timer = "due", None
                else:
                    out.append((job, timer, "removed", n))
                    status, n, timer = "", 0, None
            if kind is None or status in ("done", "failed"):
                continue
            if kind == "view" and status == "":
                status = "waiting"
                out.append((job, t, "waiting", 0))
            elif kind == "error":
                n += 1
                status, timer = ("failed", t + 604800) if n >= 3 else ("delayed", t + 2 * 2 ** (n - 1))
                out.append((job, t, status, n))
            elif kind == "purchase":
                status, timer = "done", t + 86400
                out.append((job, t, "done", n))
    return sorted(out)


def messy(seed, n=300, span=900_000):
    rng = random.Random(seed)
    rows = [(i, rng.randrange(span), rng.randrange(12), rng.choice(["view", "error", "error", "purchase", "click"])) for i in range(n)]
    return rows + [(n, 5, 50, "error"), (n + 1, 5, 50, "error"), (n + 2, 6, 50, "error"), (n + 3, 7, 50, "purchase"), (n + 4, 8, None, "error"), (n + 5, None, 1, "error")]


def frame(spark, rows):
    return spark.createDataFrame([(i, None if s is None else at(s), u, k) for i, s, u, k in rows], EVENTS)


def seconds(rows):
    base = int(at(0).timestamp()) if at(0).tzinfo else 1704067200
    return sorted((r["job"], r["at"] // 1_000_000 - base, r["status"], r["attempts"]) for r in rows)


@pytest.mark.parametrize("seed", range(3))
def test_queue_equals_plain_reading(spark, seed):
    rows = messy(seed)
    got = J.replay(J.job_events(frame(spark, rows).repartition(3), KINDS), "2024-01-20").collect()
    assert seconds(got) == plain(rows, 19 * 86400)
    assert J.replay(J.job_events(frame(spark, rows).limit(0), KINDS), "2024-01-20").count() == 0


def test_queue_as_a_stream(spark, tmp_path):
    """The same rows as the batch, however events fall into files; what the last watermark has passed is out."""
    rows = sorted((r for r in messy(7) if r[1] is not None and r[2] is not None), key=lambda r: r[1])
    rows.append((9999, 3_000_000, 77, "view"))
    for i in range(0, len(rows), 60):
        frame(spark, rows[i : i + 60]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    import os

    for i, f in enumerate(sorted((tmp_path / "in").glob("*.parquet"), key=os.path.getmtime)):
        os.utime(f, (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = J.track(J.job_events(stream, KINDS))
    q = out.writeStream.format("memory").queryName("queue").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = seconds(spark.table("queue").collect())
    assert got == plain(rows, 3_000_000 - 3600)


def test_queue_query(spark):
    got = QUERIES["job_attempts"](spark, DATA)
    assert got.count() > 0 and got.filter("attempts > 3").count() == 0


ROWS = "k long, v string, n int"


def test_batches_into_a_table(spark, tmp_path):
    path = str(tmp_path / "t")
    assert sinks.read_table(spark, path, ROWS).count() == 0
    first = spark.createDataFrame([(i, "a", 1) for i in range(100)] + [(None, "null key", 1)], ROWS)
    assert len(sinks.apply_batch(first, path, ["k"], ["n"], 8)) == 8
    files = {f: f.stat().st_mtime_ns for f in (tmp_path / "t/rows").rglob("*.parquet")}
    second = spark.createDataFrame([(5, "b", 2), (5, "older", 0), (200, "new", 1)], ROWS)
    touched = sinks.apply_batch(second, path, ["k"], ["n"], 8)
    kept = [f for f in files if f.exists()]
    assert len(touched) <= 2 and all(int(f.parent.name.split("=")[1]) not in touched for f in kept) and len(kept) >= 6
    want = {(i, "a" if i != 5 else "b", 1 if i != 5 else 2) for i in range(100)} | {(200, "new", 1), (None, "null key", 1)}
    read = lambda: {tuple(r) for r in sinks.read_table(spark, path, ROWS).collect()}
    assert read() == want
    sinks.apply_batch(second, path, ["k"], ["n"], 8)  # a replay changes nothing
    sinks.apply_batch(first, path, ["k"], ["n"], 8)  # nor does an older batch
    assert read() == want and sinks.read_table(spark, path, ROWS).count() == len(want)
    assert sinks.apply_batch(first.limit(0), path, ["k"], ["n"], 8) == []


def test_stream_into_a_table(spark, tmp_path):
    for n in range(3):
        spark.createDataFrame([(k, f"v{n}", n) for k in range(n, n + 4)], ROWS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    place, pushed = str(tmp_path / "t"), tmp_path / "pushed"
    pushed.mkdir()

    def push(rows):
        import uuid

        (pushed / uuid.uuid4().hex).write_text("".join(f"{r['k']},{r['n']}\n" for r in rows))

    for c in ("c", "d"):  # the second run has lost its checkpoint and offers every batch again
        sinks.upsert_stream(stream(), place, ["k"], ["n"], str(tmp_path / c), 4, push).awaitTermination()
        got = {r["k"]: r["n"] for r in sinks.read_table(spark, place, ROWS).collect()}
        assert got == {0: 0, 1: 1, 2: 2, 3: 2, 4: 2, 5: 2}
    assert sum(len(f.read_text().split()) for f in pushed.iterdir()) == 12


def test_merge_by_policy(spark):
    values = spark.createDataFrame(
        [
            (1, "rule", "name", "Ann", 0.9), (1, "model", "name", "Anne", 0.8), (1, "form", "name", " ", 1.0), (1, "form", "mail", None, 1.0),
            (1, "rule", "title", "clerk", 0.2), (1, "model", "title", "Chief Clerk", 0.6), (1, "a", "city", "Rome", 0.1), (1, "b", "city", "rome", 0.1), (1, "c", "city", "Oslo", 0.9),
            (1, "rule", "skills", "sql; Go", 0.5), (1, "model", "skills", "go;Rust;;", 0.5), (1, "rule", "note", "ab", 0.0), (1, "form", "note", "abc", 0.0), (1, "x", "free", "v", None),
            (2, "model", "title", "Cook", 0.1), (2, "model", "title", "Cook", 0.1), (2, None, "title", "Baker", None),
        ],
        "key long, source string, field string, value string, score double",
    )
    policy = spark.createDataFrame(
        [("name", "first", ["form", "model", "rule"], None), ("title", "confident", ["rule", "model"], 0.5), ("city", "common", [], None), ("skills", "union", ["model"], None), ("note", "longest", None, None)],
        "field string, rule string, sources array<string>, least double",
    )
    got = {(r["key"], r["field"]): (r["value"], r["source"], r["conflict"]) for r in V.merge_by_policy(values, policy).collect()}
    assert got == {
        (1, "name"): ("Anne", "model", True), (1, "title"): ("Chief Clerk", "model", True), (1, "city"): ("Rome", "a", True), (1, "skills"): ("go;Rust;sql", "model,rule", False),
        (1, "note"): ("abc", "form", True), (1, "free"): ("v", "x", False), (2, "title"): ("Cook", "model", True),
    }
    assert V.merge_by_policy(values.limit(0), policy).count() == 0




@pytest.mark.parametrize(("n", "want"), [(0, []), (3, [(0, 3)]), (10, [(0, 4), (3, 7), (6, 10)]), (11, [(0, 4), (3, 7), (6, 10), (9, 11)])])
def test_windows_cover_the_tokens(spark, n, want):
    got = spark.range(1).select(W.windows(F.lit(n), 4, 3).alias("w")).first()["w"]
    assert [tuple(w) for w in got] == want


def test_reconcile(spark):
    tags = ["O", "B-X", "I-X", "I-X", "I-X", "O", "B-Y", "I-Y"]
    rows = []
    for a, b in ((0, 4), (2, 6), (4, 8)):
        for p in range(a, b):
            cut = p == a and tags[p].startswith("I-")
            rows.append(("k", a, b, p, ("B" + tags[p][1:]) if cut else tags[p]))  # a window that begins in a run begins it anew
    rows += [("q", 0, 2, 0, "I-Z"), ("q", 0, 2, 1, "I-Z")]
    got = sorted((r["key"], r["pos"], r["tag"]) for r in W.reconcile(spark.createDataFrame(rows, "key string, start int, end int, pos int, tag string"), "key").collect())
    assert [t for k, _, t in got if k == "k"] == tags
    assert [t for k, _, t in got if k == "q"] == ["B-Z", "I-Z"]
