"""Readers, writers and streaming."""

import json

from pyspark.sql import functions as F

from corvane.sources import readers, writers
from corvane.streaming import events as S
from tests.conftest import DATA


def test_csv_round_trip(spark, tmp_path):
    (tmp_path / "in.csv").write_text('Name,Email ,Skills\n"O\'Brien, ""Pat""",p@a.com,java; go\nLee,,\n')
    df = readers.read_csv(spark, str(tmp_path / "in.csv"))
    assert df.columns == ["name", "email", "skills"]
    assert {tuple(r) for r in df.collect()} == {('O\'Brien, "Pat"', "p@a.com", "java; go"), ("Lee", "", "")}
    writers.write_csv(df, str(tmp_path / "out"))
    assert {tuple(r) for r in readers.read_csv(spark, str(tmp_path / "out")).collect()} == {tuple(r) for r in df.collect()}


def test_import_candidates(spark):
    rows = spark.createDataFrame([("Ann", "A@x.com", "1", "java; go"), ("Ann 2", "a@x.com ", "", ""), ("", "b@x.com", "", ""), ("Old", "o@x.com", "", "")], "name string, email string, phone string, skills string")
    old = spark.createDataFrame([("o@x.com",)], "e string").select(F.md5("e").alias("email_key"))
    got = writers.import_candidates(rows, old).collect()
    assert len(got) == 1 and got[0]["name"].startswith("Ann")


def test_import_without_addresses(spark):
    """Rows without an e-mail are people of their own; of equal addresses the first enters, in any order of the input."""
    given = [("Ann", "", "1", ""), ("Bob", None, "", ""), ("Cy", " ", "", ""), ("Di", "d@x.com", "", " a ;b;"), ("Di 2", "D@x.com", "", "")]
    old = spark.createDataFrame([("o@x.com",), (None,)], "e string").select(F.md5("e").alias("email_key"))
    for rows in (given, given[::-1]):
        got = writers.import_candidates(spark.createDataFrame(rows, "name string, email string, phone string, skills string"), old).collect()
        assert sorted(r["name"] for r in got) == ["Ann", "Bob", "Cy", "Di"]
        assert {r["name"]: r["skills"] for r in got}["Di"] == ["a", "b"]
    new = [(9, "z"), (9, "y"), (1, "b")]
    for rows in (new, new[::-1]):
        out = writers.insert_ignore(spark.createDataFrame([(1, "a")], "k int, v string"), spark.createDataFrame(rows, "k int, v string"), ["k"])
        assert sorted(map(tuple, out.collect())) == [(1, "a"), (9, "y")]


def test_latest_state_of_a_stream(spark, tmp_path):
    stream = S.read_events(spark, DATA)
    batch = spark.read.parquet(f"{DATA}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    got = S.run_available(S.latest_per_key(stream), "latest", str(tmp_path / "c"), "complete")
    want = {}
    for r in batch.collect():
        want[r["user_id"]] = max(want.get(r["user_id"], (r["ts"], -1)), (r["ts"], r["event_id"]))
    assert {r["user_id"]: (r["ts"], r["event_id"]) for r in got.collect()} == want


def test_conll(spark, tmp_path):
    (tmp_path / "a.conll").write_text("Ann\tB-NAME\nLee\tI-NAME\n\nat\tO\n")
    df = readers.read_conll(spark, str(tmp_path / "a.conll"))
    assert sorted((r["sent"], r["pos"], r["token"], r["label"]) for r in df.collect()) == [(0, 0, "Ann", "B-NAME"), (0, 1, "Lee", "I-NAME"), (1, 0, "at", "O")]
    lines = writers.conll_lines(df, "sent", "pos", "token", "label").orderBy("sent").select("value")
    assert [r[0] for r in lines.collect()] == ["Ann\tB-NAME\nLee\tI-NAME\n", "at\tO\n"]


def test_json_and_feedback(spark, tmp_path):
    for i in range(4):
        (tmp_path / f"{i}.json").write_text(json.dumps({"id": i, "type": "x" if i % 2 else "y"}))
    assert readers.read_json_records(spark, str(tmp_path)).count() == 4
    assert [r["id"] for r in readers.read_feedback(spark, str(tmp_path), 2, "y").collect()] == [2]


def test_texts_bytes_terms_and_exports(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo")
    (tmp_path / "b.bin").write_bytes(b"\x00\x01")
    got = readers.read_texts(spark, str(tmp_path / "a.txt")).collect()
    assert [(r["path"].rsplit("/", 1)[1], r["text"]) for r in got] == [("a.txt", "one\ntwo")]
    got = readers.read_binary(spark, str(tmp_path), "*.bin").collect()
    assert [(r["length"], bytes(r["content"])) for r in got] == [(2, b"\x00\x01")]
    terms = readers.taxonomy(spark, [("sql", "data"), ("tea", " ")])
    assert {tuple(r) for r in terms.collect()} == {("sql", "data"), ("tea", "general")}
    labelled = spark.createDataFrame([(1, "accept"), (2, "skip"), (3, "accept"), (4, "edit")], "k int, action string")
    records = spark.createDataFrame([(1, "x"), (2, "y"), (3, ""), (4, None)], "k int, body string")
    assert [tuple(r) for r in readers.training_export(labelled, records, "k", ["accept", "edit"], "body").collect()] == [(1, "accept", "x")]
    assert [r[0] for r in writers.json_rows(spark.createDataFrame([(1, None), (2, "z")], "a int, b string")).collect()] == ['{"a":1}', '{"a":2,"b":"z"}']


def test_soft_delete(spark):
    df = spark.createDataFrame([(1, "new", None), (2, "new", None)], "k int, status string, deleted_at string")
    got = writers.soft_delete(df, F.col("k") == 2, F.lit("2024-01-01")).orderBy("k").collect()
    assert [tuple(r) for r in got] == [(1, "new", None), (2, "deleted", "2024-01-01")]


def test_maintenance(spark, tmp_path):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    show = lambda df: sorted(tuple(r) for r in df.collect())
    assert show(writers.upsert(old, new, ["k"])) == [(1, "a"), (2, "c"), (3, "d")]
    assert show(writers.insert_ignore(old, new, ["k"])) == [(1, "a"), (2, "b"), (3, "d")]
    assert show(writers.expire_not_seen(old, new, "k").select("k", "is_active")) == [(1, False), (2, True)]
    p = str(tmp_path / "t")
    writers.replace_partitions(old, p, "k")
    writers.replace_partitions(new, p, "k")
    assert show(spark.read.parquet(p).select("k", "v")) == [(1, "a"), (2, "c"), (3, "d")]


def test_stream_equals_batch(spark, tmp_path):
    stream = S.read_events(spark, DATA)
    batch = spark.read.parquet(f"{DATA}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    got = S.run_available(S.daily_counts(stream), "daily", str(tmp_path / "c"), "complete")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, S.daily_counts(batch).collect()))
    got = S.run_available(S.distinct_events(stream), "once", str(tmp_path / "d"))
    assert got.count() == batch.select("event_id").distinct().count()


def zipped(path, part, body):
    import zipfile

    with zipfile.ZipFile(path, "w") as z:
        z.writestr("mimetype", "x")
        z.writestr(part, body)


def test_office_documents(spark, tmp_path):
    w = 'xmlns:w="http://x/w"'
    zipped(tmp_path / "a.docx", "word/document.xml", f"<w:document {w}><w:body><w:p><w:r><w:t>Ünï one</w:t><w:tab/><w:t>two</w:t></w:r></w:p><w:p><w:r><w:t>three</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>")
    zipped(tmp_path / "b.odt", "content.xml", '<o:doc xmlns:o="u:o" xmlns:t="u:t"><o:body><t:h>Head</t:h><t:p>one <t:span>bold</t:span> end</t:p><t:p/></o:body></o:doc>')
    zipped(tmp_path / "c.docx", "other.xml", "<a/>")
    zipped(tmp_path / "d.docx", "word/document.xml", "<w:p>")
    (tmp_path / "e.docx").write_bytes(b"not a zip")
    (tmp_path / "f.txt").write_bytes("\ufeffplain\nlines".encode())
    (tmp_path / "g.bin").write_bytes(b"left alone")
    zipped(tmp_path / "h.docx", "word/document.xml", f"<w:d {w}>" + "".join(f"<w:p><w:t>line {i}</w:t></w:p>" for i in range(20000)) + "</w:d>")
    got = {r["path"].rsplit("/", 1)[1]: r for r in readers.read_office(spark, str(tmp_path)).collect()}
    assert {k: r["text"] for k, r in got.items() if k < "g"} == {"a.docx": "Ünï one\ttwo\nthree\ncell", "b.odt": "Head\none bold end", "c.docx": None, "d.docx": None, "e.docx": None, "f.txt": "plain\nlines"}
    assert "BadZipFile" in got["e.docx"]["error"] and "no text part" in got["c.docx"]["error"] and got["h.docx"]["text"].count("\n") == 19999 and "g.bin" not in got
    short = {r["path"].rsplit("/", 1)[1]: r["error"] for r in readers.read_office(spark, str(tmp_path), longest=5000).collect()}
    assert "h.docx" not in short or "too long" in short["h.docx"]
    assert readers.read_office(spark, str(tmp_path), newer_than="2999-01-01").count() == 0


def test_feedback_opens_the_newest_only(spark, tmp_path):
    for i in range(5):
        (tmp_path / f"{i}.json").write_text("{broken" if i < 3 else json.dumps({"id": i, "type": "x"}))
    df = readers.read_feedback(spark, str(tmp_path), 2)
    assert sorted(r["id"] for r in df.collect()) == [3, 4] and all("broken" not in str(f) for f in df.inputFiles()) and len(df.inputFiles()) == 2
    assert readers.read_feedback(spark, str(tmp_path), 0).count() == 0
