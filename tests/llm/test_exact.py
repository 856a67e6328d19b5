"""Packing, mixing, span dedup, licenses and near-dedup against brute force, with awkward rows."""

import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import components, licenses, minhash_dedup, mixing, packing, span_dedup, wordhash
from corvane.llm._common import WORD, block_pairs
from tests.conftest import DATA

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 977} x{i % 13}." for i in range(9000))


def awkward(spark):
    """Nulls, empty and long texts, ties, repeated rows, and column names that operators use inside."""
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n ", "en", "a", 4), (4, LONG, "en", "a", 1), (5, LONG, "en", None, 1), (6, "one", "en", "b", 3), (6, "one", "en", "b", 3), (None, "one two three", "en", "b", 3), (7, "café ñ <|endoftext|> x  y", "fr", "c", 9)]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({c: F.lit("clash") for c in ("rep", "root", "key", "n_shingles", "taken", "ids", "score", "h", "u", "sig", "span", "license", "digest")})


def docs(spark, n=200):
    return spark.read.parquet(f"{DATA}/documents.parquet").limit(n)


def words(t):
    return re.findall(WORD, t or "")


# packing


def tokens(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [*t.encode(text or "", add_special_tokens=False).ids, 0]


def check_packing(rows, given):
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, text in given:
        ids, at = np.array(tokens(text), dtype="<u4"), 0
        own = sorted((r for r in pieces[i] if r["doc_tokens"] == len(ids)), key=lambda r: r["start"])
        for r in own:
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    padding = 0
    for w in windows.values():
        at = 0
        for offset, length in sorted(w):
            assert offset == at
            at += length
        assert at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    return padding


def test_packing(spark):
    df = docs(spark).repartition(7)
    got = packing.pack(df, with_ids=False, fan=3).collect()
    assert check_packing(got, [(r["doc_id"], r["text"]) for r in df.collect()]) < 1024
    assert sorted(map(tuple, got)) == sorted(map(tuple, packing.pack(df, with_ids=False, fan=3).collect()))


def test_packing_ids_round_trip(spark):
    rows = packing.pack(awkward(spark).filter("doc_id in (1, 2, 4, 7)")).orderBy("doc_id", "start").collect()
    back = defaultdict(list)
    for r in rows:
        back[r["doc_id"]] += np.frombuffer(r["ids"], dtype="<u4").tolist()
    given = {r["doc_id"]: r["text"] for r in awkward(spark).collect()}
    assert all(back[i] == tokens(given[i]) for i in (1, 2, 4, 7))


def test_packing_repeated_rows(spark):
    assert sum(r["length"] for r in packing.pack(awkward(spark), with_ids=False).collect()) == sum(len(tokens(r["text"])) for r in awkward(spark).collect())
    assert packing.pack(awkward(spark).limit(0), with_ids=False).count() == 0


@pytest.mark.parametrize("text", ["a  b", " a", "a ", "a\n\nb", "a\tb c", "it's 12 don't!", "é b　d", "a\n b", "a \nb", "x" * 3000, "\n", "a\x1cb \x85 c"])
def test_encoder_equals_tokenizer(text):
    import public_tokenizers as P

    enc = packing.encoder(P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    assert np.frombuffer(enc.encode(text), "<u4").tolist() == tokens(text)[:-1]


# mixing


def check_mix(rows, given):
    size = defaultdict(int)
    for r in given:
        size[r["source"]] += len(words(r["text"]))
    names = sorted((s for s in size if s is not None)) + [s for s in size if s is None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    capped: set = set()
    while True:
        rate = (1.5 * sum(size.values()) - sum(2 * size[s] for s in capped)) / (sum(weight[s] for s in names if s not in capped) or 1)
        new = {s for s in names if rate * weight[s] > 2 * size[s]} | capped
        if new == capped:
            break
        capped = new
    taken = defaultdict(int)
    for r in rows:
        taken[r["source"]] += r["taken"]
        want = 2 * size[r["source"]] if r["source"] in capped else rate * weight[r["source"]]
        assert r["target"] == pytest.approx(want) and r["source_size"] == size[r["source"]]
        assert 0 <= r["taken"] <= 2 * r["size"]
    assert all(abs(taken[r["source"]] - r["target"]) <= 1 for r in rows)


def test_mixing(spark):
    df = docs(spark)
    got = mixing.mix(df, fan=4).collect()
    assert len(got) == df.count()
    check_mix(got, df.collect())
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df.repartition(5), fan=4).collect()))
    cut_short = [r for r in got if r["size"] and r["taken"] % r["size"]]
    assert len(cut_short) <= df.select("source").distinct().count()


def test_mixing_is_unbiased(spark):
    df = docs(spark, 60).withColumn("source", F.when(F.col("doc_id") % 2 == 0, "a").otherwise("b"))
    runs = [mixing.mix(df, seed=s, fan=8).filter("size > 0").agg(F.avg(F.col("taken") / F.col("size") - F.col("target") / F.col("source_size"))).first()[0] for s in range(4)]
    assert abs(sum(runs) / 4) < 0.1


def test_mixing_awkward(spark):
    df = awkward(spark)
    got = mixing.mix(df).collect()
    assert len(got) == df.count()
    check_mix(got, df.collect())
    assert mixing.mix(df.limit(0)).count() == 0


def test_resample_takes_what_the_mix_says(spark):
    df = docs(spark, 80)
    want = {r["doc_id"]: r["taken"] for r in mixing.mix(df).collect() if r["taken"]}
    out = mixing.resample(df)
    assert out.schema == df.schema
    got = defaultdict(int)
    for r in out.collect():
        got[r["doc_id"]] += len(words(r["text"]))
    assert got == want
    assert mixing.resample(awkward(spark)).columns == awkward(spark).columns


# span dedup


def sentences(text):
    out, cur = [], []
    for m in re.finditer(WORD + r"([\x20\x09-\x0D]*)", text or ""):
        w = m.group().rstrip(" \t\n\r\v\f")
        cur.append(re.sub("[A-Z]", lambda x: x.group().lower(), w))
        if w[-1] in ".!?" or "\n" in m.group(1):
            out.append(tuple(cur))
            cur = []
    return out + ([tuple(cur)] if cur else [])


def brute_spans(given, run=3):
    """Sentences that repeated runs cover, and words that stand in a 38-word stretch met before."""
    where, gone = defaultdict(list), defaultdict(set)
    for i, text in given:
        s = sentences(text)
        for a in range(len(s) - run + 1):
            where[tuple(s[a : a + run])].append((i, a))
    for places in where.values():
        for i, a in sorted(places)[1:]:
            gone[i] |= set(range(a, a + run))
    seen, again = set(), defaultdict(set)
    for i, text in sorted(given):
        w = [x for s in sentences(text) for x in s]
        for k in range(len(w) - 37):
            stretch = tuple(w[k : k + 38])
            if stretch in seen:
                again[i] |= set(range(k, k + 38))
            seen.add(stretch)
    return gone, again


def test_span_dedup(spark):
    df = docs(spark)
    passage = "Alpha beta gamma delta. Eta theta iota. Nu xi omicron pi. Phi chi psi omega end."
    extra = spark.createDataFrame([(9001, "Start here with words. " + passage + " Then another close."), (9002, "unfinished line " + passage + " And done."), (9003, "Only two. Phi chi psi omega end. Nu xi omicron pi. Done here.")], "doc_id long, text string")
    df = df.select("doc_id", "text").unionByName(extra)
    given = [(r["doc_id"], r["text"]) for r in df.collect()]
    got = {r["doc_id"]: r for r in span_dedup.remove_repeats(df).collect()}
    # the first sentence of the passage is cut into another in 9002, the last three form a run; two sentences are none
    assert [got[i]["n_removed"] for i in (9001, 9002, 9003)] == [0, 3, 0] and "Phi chi" not in got[9002]["text"] and got[9002]["first_in"] == [9001]
    gone, again = brute_spans(given)
    assert sum(map(len, gone.values())) > 100
    for i, text in given:
        places = [(m.start(), m.end()) for m in re.finditer(WORD, text or "")]
        lost = {k for k, (s, _) in enumerate(places) if any(x["start"] <= s < x["end"] for x in got[i]["removed"])}
        s, k, must, touched = sentences(text), 0, set(), 0
        for n, sentence in enumerate(s):
            own = set(range(k, k + len(sentence)))
            must |= own if n in gone[i] else set()
            touched += bool(own & lost)
            k += len(sentence)
        assert must <= lost <= must | again[i] and len(lost) == got[i]["words_removed"] and touched == got[i]["n_removed"]
        kept, last = "", 0
        for x in got[i]["removed"]:
            kept, last = kept + text[last : x["start"]], x["end"]
        assert kept + text[last:] == got[i]["text"] and got[i]["n_sentences"] == len(s)


def test_span_dedup_of_rows(spark):
    """Rows that share an id go by their own texts, and rows without an id are removed from as well."""
    a, b = "One two three. Four five. Six seven eight.", "Nine ten. Eleven twelve. Thirteen."
    rows = [(5, a), (5, b), (7, a), (None, "Other start. " + b), (None, "Other start. " + b), (5, a)]
    for given in (rows, rows[::-1]):
        got = span_dedup.remove_repeats(spark.createDataFrame(given, "doc_id long, text string")).collect()
        assert sorted((str(r["doc_id"]), r["n_removed"], r["text"].strip()) for r in got) == sorted([("5", 0, a), ("5", 0, a), ("5", 0, b), ("7", 3, ""), *[("None", 3, "Other start.")] * 2])


def test_span_dedup_awkward(spark):
    got = span_dedup.remove_repeats(awkward(spark)).collect()
    assert len(got) == 9
    text = {r["doc_id"]: r["text"] for r in got}
    assert text[1] is None and text[2] == "" and text[6] == "one" and len(text[5]) < len(text[4])
    assert span_dedup.remove_repeats(awkward(spark).limit(0)).count() == 0


def test_span_dedup_meets_every_repeat_of_fifty_words(spark):
    rng = np.random.default_rng(5)
    fresh = lambda n: [f"v{x}" for x in rng.integers(0, 10**9, n)]
    p, q, r = fresh(64), fresh(50), fresh(51)
    p[13] += "."  # one whole sentence between two cut ones
    p[42] += "."
    given = [(9101, p), (9102, p), (9103, q), (9104, q), (9105, r), (9106, r)]
    extra = [(i, " ".join(fresh(7) + w + fresh(9)) + ".") for i, w in given] + [(9107, "same " * 120)]
    df = docs(spark).select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    got = {r["doc_id"]: r for r in span_dedup.remove_repeats(df).collect()}
    assert [got[i]["words_removed"] >= 38 for i in range(9101, 9107)] == [False, True] * 3
    assert got[9102]["first_in"] == [9101] and got[9107]["text"].split() == ["same"] * 38
    seen = {}
    for i, text in sorted((r["doc_id"], r["text"]) for r in df.collect() if r["doc_id"] != 9107):
        at = [(m.start(), m.end()) for m in re.finditer(WORD, text or "")]
        w = [re.sub("[A-Z]", lambda x: x.group().lower(), text[s:e]) for s, e in at]
        gone = np.zeros(len(w) + 1, int)
        for x in got[i]["removed"]:
            gone[[k + 1 for k, (s, _) in enumerate(at) if x["start"] <= s < x["end"]]] = 1
        assert gone.sum() == got[i]["words_removed"]
        gone = gone.cumsum()
        for k in range(len(w) - 49):
            if seen.setdefault(tuple(w[k : k + 50]), i) != i:
                assert gone[k + 50] - gone[k] >= 38


# licenses


def test_licenses_match_sql(spark):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{DATA}/documents.parquet')")
    got = licenses.scan(docs(spark)).select("doc_id", "digest", "license", "line_licenses").collect()
    assert sorted(map(tuple, got)) == sorted(c.execute(licenses.oracle()).fetchall())


def test_license_spelling(spark):
    mit = dict(reversed(licenses.KNOWN[:1]))["MIT"]
    rows = [(1, "Copyright (c) 2020 Someone\n\n" + mit.upper().replace("LICENSE", "LICENCE")), (2, mit.replace(",", " ;")), (3, mit + " more"), (4, "Text.\n  released under THE mit licence!\nend"), (5, None), (6, "...")]
    got = {r["doc_id"]: (r["license"], r["line_licenses"]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("MIT", ""), 2: ("MIT", ""), 3: (None, ""), 4: (None, "MIT"), 5: (None, ""), 6: (None, "")}
    assert licenses.scan(awkward(spark)).count() == 9 and licenses.scan(awkward(spark).limit(0)).count() == 0


def test_license_lines_and_spellings(spark):
    """A known text's own holder line gives no mark, spellings next to each other are all taken, rows without an id are looked up."""
    texts = spark.createDataFrame([("Own", "Copyright (c) 2020 Averyveryverylongholdername\nfree to use by all"), ("Two", "the licence licence text"), ("Nothing", " -- ")], "license string, text string")
    rows = [(1, "before\nfree to use by all\nafter"), (2, "the license license text"), (None, "a\nThe Licence, License text!"), (3, " -- "), (3, "Copyright 1999 X\nFREE to use\nby all")]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), texts).select("doc_id", "license", "line_licenses").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, None, "Own"), (2, "Two", "Two"), (None, None, "Two"), (3, None, ""), (3, "Own", "")], key=str)


def test_license_lines_with_many_known_texts(spark):
    """Beyond a number of marks every line is looked up: with the same result."""
    texts = [(f"L{i}", f"terms number{i:03d}x of use") for i in range(200)]
    rows = [(i, f"first\nTerms number{i * 7:03d}x of use.\nlast") for i in range(30)]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(texts, "license string, text string")).collect()
    assert {r["doc_id"]: r["line_licenses"] for r in got} == {i: f"L{i * 7}" if i * 7 < 200 else "" for i in range(30)}


def test_license_digests(spark):
    """The shipped digests are those of the texts that Debian installs, where they are at hand."""
    from pathlib import Path

    names = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0-only", "GPL-3": "GPL-3.0-only", "LGPL-2.1": "LGPL-2.1-only", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    rows = [(n, f.read_text()) for f, n in ((Path("/usr/share/common-licenses", f), n) for f, n in names.items()) if f.exists()]
    if not rows:
        pytest.skip("no license texts here")
    # other line breaks and another holder make no difference
    docs_ = [(i, "Copyright 2024 Somebody\n\n" + t.replace("\n", "\r\n").upper()) for i, (_, t) in enumerate(rows)]
    got = {r["doc_id"]: r["license"] for r in licenses.scan(spark.createDataFrame(docs_, "doc_id long, text string")).collect()}
    assert got == {i: n for i, (n, _) in enumerate(rows)}


# near-dedup


def sets(text, n):
    w = [re.sub("[A-Z]", lambda x: x.group().lower(), x) for x in words(text)]
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def brute_groups(given, n, percent):
    s = {i: sets(t, n) for i, t in given}
    root = {i: i for i in s}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(s)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if s[a] and s[b] and 100 * len(s[a] & s[b]) >= percent * len(s[a] | s[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}, {i: len(v) for i, v in s.items()}


@pytest.mark.parametrize(("n", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, n, percent, monkeypatch):
    base = [(r["doc_id"], r["text"]) for r in docs(spark).collect()]
    rng = np.random.default_rng(1)
    source = [w for w in words(base[0][1])] * 2
    for k in range(40):  # a family around one text, with links near the threshold
        w = list(source[:300])
        for j in rng.choice(300, int(rng.integers(0, 16)), replace=False):
            w[j] = f"new{k}x{j}"
        base.append((5000 + k, " ".join(w)))
    df = spark.createDataFrame(base, "doc_id long, text string")
    want, size = brute_groups(base, n, percent)
    monkeypatch.setattr(minhash_dedup, "LIST_BLOCK", 16)
    monkeypatch.setattr(minhash_dedup, "FAMILY_BLOCK", 8)
    monkeypatch.setattr(minhash_dedup, "STAR_BLOCK", 8)
    got = minhash_dedup.near_duplicates(df, words=n, percent=percent).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert {r["doc_id"]: r["n_shingles"] for r in got} == size
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    kept = minhash_dedup.keep_one(df, minhash_dedup.near_duplicates(df, words=n, percent=percent))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))


def test_near_duplicates_awkward(spark):
    df = awkward(spark)
    got = minhash_dedup.near_duplicates(df)
    rows = {(r["doc_id"], r["n_shingles"]): (r["component_id"], r["kept"]) for r in got.collect()}
    assert got.count() == 9 and rows[(1, 0)] == (1, True) and rows[(5, rows_n := next(n for d, n in rows if d == 5))] == (4, False) and rows_n > 1000
    assert rows[(None, 1)] == (None, True)
    assert sorted(str(r["doc_id"]) for r in minhash_dedup.keep_one(df, got).collect()) == sorted(["1", "2", "3", "4", "6", "7", "None"])
    assert minhash_dedup.near_duplicates(df.limit(0)).count() == 0


def test_near_duplicates_go_by_row(spark):
    one, two, three = (" ".join(f"{c}{i}" for i in range(60)) for c in "abc")
    rows = [(3, one), (5, one + " end"), (5, two), (5, two), (6, two + " end"), (8, three), (8, three + " end"), (None, one), (None, "n " + three), (None, "x y z"), (None, "x y z"), (None, "p q r"), (None, None), (None, " "), (9, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for some in (df, df.repartition(5).orderBy(F.desc("text"))):
        found = minhash_dedup.near_duplicates(some)
        assert found.count() == len(rows)
        kept = [tuple(r) for r in minhash_dedup.keep_one(some, found).collect()]
        threes = [r for r in kept if r[0] == 8]
        assert len(threes) == 1 and sorted(map(str, kept)) == sorted(map(str, [(3, one), (5, two), *threes, (None, "x y z"), (None, "p q r"), (None, None), (None, " "), (9, None)]))
    assert {(r["doc_id"], r["component_id"]) for r in found.collect()} == {(3, 3), (5, 3), (5, 5), (6, 5), (8, 8), (None, 3), (None, 8), (None, None), (9, 9)}


def test_matches_needed_misses_little():
    from math import comb

    for s in (0.8, 0.85):
        t = minhash_dedup.matches_needed(s, 64)
        assert sum(comb(64, i) * s**i * (1 - s) ** (64 - i) for i in range(t)) < 1e-9


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = components.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    assert {r["node"]: r["root"] for r in got} == {x: find(x) for x in root if find(x) != x}
    assert components.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_component_state_holds_any_number_of_edges(spark):
    rows = spark.range(1 << 25).select(F.lit(2).cast("long").alias("hi"), F.lit(1).cast("long").alias("lo"))
    assert components._state(rows)[0] == 1 << 25
    some = spark.createDataFrame([(3, 1), (2, 1), (9, 4)], "hi long, lo long")
    assert components._state(some) == components._state(some.orderBy("hi")) != components._state(some.filter("hi <> 9"))


def test_block_pairs_meet_all(spark):
    df = spark.range(50).select(F.lit(1).alias("g"), F.lit(50).alias("n"), "id")
    rows = block_pairs(df, "n", "id", 12).collect()
    meet = {(a["id"], b["id"]) for a in rows for b in rows if (a["blk_p"], a["blk_q"]) == (b["blk_p"], b["blk_q"])}
    assert len(meet) == 2500


def test_word_hashes():
    h, n = wordhash.word_hashes(["  Ab cd\n\tab ", None, "", "   ", "ab\x0bÉ é"])
    assert n.tolist() == [3, 0, 0, 0, 3] and h[0] == h[2] == h[3] and h[4] != h[5] and len(set(h.tolist())) == 4
    v, s = wordhash.shingles(["a b c a b c a", "a b", ""], 3)
    assert s.tolist() == [3, 1, 0] and len(v) == 4


def test_resample_of_rows_without_ids(spark):
    """Rows without an id are rows of their own, equal rows one with its takes added up; words come near the targets."""
    rows = [(None, f"word {i} and some more", "en", "a", i) for i in range(400)] + [(None, "same words here", "en", "b", 0)] * 300 + [(None, None, "en", "b", 0), (7, "x y", "en", None, 1)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("_s", F.lit(1))
    a, b = (sorted(map(str, mixing.resample(d).collect())) for d in (df, df.repartition(9)))
    assert a == b
    got = mixing.resample(df).select("source", mixing.word_count(F.col("text")).alias("n")).groupBy("source").agg(F.sum("n").alias("n"))
    words_of = {r["source"]: r["n"] for r in got.collect()}
    aims = {r["source"]: r["target"] for r in mixing.mix(df).select("source", "target").distinct().collect()}
    assert all(abs(words_of.get(s, 0) - t) <= 1 for s, t in aims.items() if t)


def test_many_rows_without_an_id_share_no_group(spark):
    """40,000 rows without an id, of different sizes, are dealt over groups."""
    df = spark.range(8000).select(F.lit(None).cast("long").alias("doc_id"), F.array_join(F.array_repeat(F.lit("w"), (F.col("id") % 4000 + 1).cast("int")), " ").alias("text"), F.lit("s").alias("source"))
    out = mixing.mix(df).agg(F.sum("taken").alias("t"), F.max(F.col("taken") / F.col("size")).alias("m"), F.first("target").alias("target")).first()
    assert abs(out["t"] - out["target"]) <= 1 and out["m"] <= 2


def test_scratch_is_deleted(spark, tmp_path, monkeypatch):
    from corvane.llm import _common

    monkeypatch.setattr(_common, "shared_dir", lambda _: str(tmp_path))
    with _common.scratch(spark):
        _common.cut(spark.range(5).toDF("a"))
        kept = _common.cut(spark.range(7).toDF("a"), part="")
        assert len(list(tmp_path.rglob("_SUCCESS"))) == 2
    assert kept.count() == 7 and len(list(tmp_path.rglob("_SUCCESS"))) == 1
