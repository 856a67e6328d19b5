"""Operator 12. Line dedup, in DataFrame functions only.

Texts are exploded into lines, each line's key is hashed (two 64-bit hashes), documents are counted for each hash, and lines
whose key is in ``documents`` documents or more are dropped everywhere but in the document with the largest id that holds it.
What is left is put together again by position.

Plan: hashes are counted with documents as a second key, so that a line that a third of all documents share is counted in many
tasks; the frequent keys are written out, so that both sides of their join to the lines are plain shuffles and adaptive execution
can split a hot key or broadcast a small table.  Texts themselves are moved once, to meet the positions they lose.

Defined cases: a null or empty text is one empty line; a key is the line without white space (space, U+0009..U+000D) at both ends,
A-Z lower-cased, and counts from ``least`` code points on; a line that a document holds several times counts once and goes or
stays as a whole.  Rows with one id are one document, and rows without an id are one document together, the smallest; each row is
still returned by itself.  Very long texts are cut whole: their lines' work is linear.  An empty table gives no rows; other columns are
not returned, whatever their names.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm._common import cut

SPACE = " \t\n\x0b\x0c\r"


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, nothing else; texts of ASCII alone take the quick way."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def _text() -> Column:
    return F.coalesce("text", F.lit(""))


def keyed_lines(docs: DataFrame, least: int) -> DataFrame:
    """``doc_id, mark, pos, h1, h2``: lines with a key of ``least`` code points or more; ``mark`` tells texts of one id apart."""
    bare = F.btrim("line", F.lit(SPACE))
    lines = docs.select("doc_id", F.xxhash64(_text()).alias("mark"), F.posexplode(F.split(_text(), "\n")).alias("pos", "line"))
    keys = lines.filter((F.length("line") >= least) & (F.length(bare) >= least)).select("doc_id", "mark", "pos", lower_ascii(bare).alias("key"))
    return keys.select("doc_id", "mark", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("key"), "key").alias("h2"))


def frequent(lines: DataFrame, documents: int) -> DataFrame:
    """``h1, h2, last``: keys of that many documents, and the largest id that holds each (null: only rows without an id)."""
    found = lines.groupBy("h1", "h2").agg(F.count_distinct("doc_id").alias("ids"), F.max(F.col("doc_id").isNull()).alias("none"), F.max("doc_id").alias("last"))
    return found.filter(F.col("ids") + F.col("none").cast("int") >= documents).select("h1", "h2", "last")


def dropped_positions(docs: DataFrame, least: int = 20, documents: int = 3) -> DataFrame:
    """``doc_id, mark, gone``: positions (from 0, ascending) of the lines that go; texts that lose none have no row."""
    lines = keyed_lines(docs, least)
    hot = cut(frequent(lines, documents))
    gone = lines.join(hot, ["h1", "h2"]).filter(~F.col("doc_id").eqNullSafe(F.col("last")))
    return gone.groupBy("doc_id", "mark").agg(F.sort_array(F.collect_set("pos")).alias("gone"))


def _rest(lines: Column, gone: Column) -> Column:
    """The lines between the positions that go, joined: runs are sliced out, so the work is linear in the lines."""

    def run(edges: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(edges) - 2)
        return F.flatten(F.transform(at, lambda i: F.slice(lines, F.get(edges, i) + 2, F.get(edges, i + 1) - F.get(edges, i) - 1)))

    edges = F.concat(F.array(F.lit(-1)), gone, F.array(F.size(lines)))
    return F.array_join(F.get(F.transform(F.array(edges), run), F.lit(0)), "\n")


def remove_lines(docs: DataFrame, least: int = 20, documents: int = 3) -> DataFrame:
    """``doc_id, text, n_lines, n_dropped`` of every row of ``docs``; ``text`` is what is left."""
    gone = cut(dropped_positions(docs, least, documents)).select(F.col("doc_id").alias("gone_id"), F.col("mark").alias("gone_mark"), "gone")
    rows = docs.select("doc_id", _text().alias("text")).withColumn("mark", F.xxhash64("text"))
    met = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("mark") == F.col("gone_mark")), "left")
    # the split text is bound once behind a transform, or each slice would split it anew
    kept = F.get(F.transform(F.array(F.split("text", "\n")), lambda lines: _rest(lines, F.col("gone"))), F.lit(0))
    n_lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    return met.select(
        "doc_id",
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("text"),
        n_lines.cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def oracle(least: int = 20, documents: int = 3) -> str:
    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
    l AS (SELECT r, doc_id, unnest(a) AS line, unnest(range(len(a))) AS pos FROM d),
    k AS (SELECT *, trim(translate(line, '{string.ascii_uppercase}', '{string.ascii_lowercase}'),
                         ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key FROM l),
    hot AS (SELECT key AS hot_key, max(doc_id) AS last FROM k WHERE length(key) >= {least} GROUP BY key
            HAVING count(DISTINCT doc_id) + max((doc_id IS NULL)::INT) >= {documents}),
    m AS (SELECT *, hot_key IS NOT NULL AND doc_id IS DISTINCT FROM last AS gone FROM k LEFT JOIN hot ON key = hot_key)
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
    FROM m GROUP BY r, doc_id"""
