"""Operator 11. Source divergence audit by joint count histograms.

Within each language every source is a distribution over the kept terms (those of at least ``documents`` of the language's
documents), smoothed and in whole billionths.  Two sources are as far apart as the sum of the differences over all kept terms, and
a source's own words are those it uses more than its language does.

Method: for a pair of sources only the tally of distinct (count, count) combinations matters.  Terms that both hold are tallied
from the terms' lists of sources; cells with a zero are implied: they follow from each source's own histogram of counts and from
the number of kept terms by subtraction, so terms that a source lacks are never listed.  The difference is then taken once for each
combination and multiplied by its cell.  All sums are of whole numbers; products are taken as decimals, which hold 38 digits.

Plan: occurrences are added up in the map tasks by (language, source, term), first in counters of bounded size in Python, which
splits a text some ten times as fast as a regular expression, then in Spark, so a source with a third of all rows is no hot key;
one shuffle by (language, term) serves the counts of sources and of languages alike;
lists of sources are by (language, term) and cut into blocks of ``width`` sources, each pair of blocks a row of its own.  The
tallies are partial counts again.  The result itself has a row for each ordered pair of a language's sources.

Defined cases: null text, lang and source are read as ''; a group without terms has count 0 everywhere; a language without kept
terms gives value 0 for its pairs and no terms; every row counts as a document of its own, also with a repeated or null id; equal values are
ranked by the item's UTF-8 bytes; very long texts are read whole; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm._common import block_pairs, cut, slices

#: A term: a run of letters a-z, A-Z and characters beyond ASCII.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
UNIT = 1_000_000_000
SMOOTH = 5


def _share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(UNIT * (count + SMOOTH) / (total + SMOOTH * kept)), exact."""
    above = F.lit(UNIT).cast("decimal(10,0)") * (count + SMOOTH).cast("decimal(19,0)")
    return F.call_function("div", above, (total + SMOOTH * kept).cast("decimal(19,0)")) + F.lit(1)


#: What each byte of UTF-8 becomes: A-Z lower-cased, bytes of no term blank. Bytes of characters beyond ASCII are all above 0x7F.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))
#: Counters of a task are handed on at this many entries.
ENTRIES = 300_000


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and rows of each term by group, over a bounded number of entries at a time."""
    counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("n_docs", pa.int64())])

    def packed() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, rows) in counts.items():
            terms = pa.array(list(n), pa.binary()).cast(pa.string())
            of = [pa.repeat(pa.scalar(v, pa.string()), len(n)) for v in (lang, source)]
            yield pa.RecordBatch.from_arrays([*of, terms, pa.array(n.values(), pa.int64()), pa.array(map(rows.__getitem__, n), pa.int64())], schema=schema)
        counts.clear()

    for batch in batches:
        for part in slices(batch, "text"):
            for lang, source, text in zip(*[part.column(part.schema.get_field_index(c)).to_pylist() for c in ("lang", "source", "text")], strict=True):
                n, rows = counts.setdefault((lang, source), (Counter(), Counter()))
                terms = text.encode().translate(_BYTES).split(b" ")
                n.update(terms)
                rows.update(set(terms))
                n.pop(b"", None)
            if sum(len(n) for n, _ in counts.values()) >= ENTRIES:
                yield from packed()
    yield from packed()


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, n_docs``: occurrences of each term, and rows that hold it."""
    rows = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    found = rows.mapInArrow(_count, "lang string, source string, term string, n long, n_docs long").repartition("lang", "term")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))


class Audit:
    """The counts that both parts read, each written out once."""

    def __init__(self, docs: DataFrame, documents: int = 30, width: int = 64):
        of = Window.partitionBy("lang", "term")
        counts = term_counts(docs).withColumns({"lang_n": F.sum("n").over(of), "d": F.sum("n_docs").over(of)})
        self.entries = cut(counts.filter(F.col("d") >= documents).drop("n_docs", "d"))
        of_term = self.entries.groupBy("lang", "term").agg(F.first("lang_n").alias("lang_n"))
        langs = of_term.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_total"))
        totals = self.entries.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        none = F.lit("")
        groups = docs.select(F.coalesce("lang", none).alias("lang"), F.coalesce("source", none).alias("source")).distinct()
        groups = groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "v", "lang_total"])
        self.groups, self.width = cut(groups), width

    def _pairs(self) -> DataFrame:
        """``lang, a, b`` with a < b and what their shares need."""
        a = self.groups.select("lang", "v", F.col("source").alias("a"), F.col("total").alias("total_a"))
        b = self.groups.select("lang", F.col("source").alias("b"), F.col("total").alias("total_b"))
        return cut(a.join(b, "lang").filter("a < b"))

    def _shared(self) -> DataFrame:
        """``lang, a, b, x, y, m``: of how many terms the pair's counts are x and y, both above 0."""
        sizes = self.groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources"))
        own = F.pmod(F.xxhash64("source"), F.ceil(F.col("sources") / F.lit(self.width))).alias("own")
        dealt = block_pairs(self.entries.join(sizes, "lang"), "sources", "source", self.width)
        lists = dealt.select("lang", "term", "blk_p", "blk_q", F.struct("source", "n", own).alias("e")).groupBy("lang", "term", "blk_p", "blk_q").agg(F.collect_list("e").alias("es"))

        def partners(x: Column) -> Column:
            others = F.filter("es", lambda y: (y["source"] > x["source"]) & ((F.col("blk_p") == F.col("blk_q")) | (y["own"] != x["own"])))
            return F.transform(others, lambda y: F.struct(x["source"].alias("a"), y["source"].alias("b"), x["n"].alias("x"), y["n"].alias("y")))

        pairs = lists.select("lang", F.explode(F.flatten(F.transform("es", partners))).alias("p")).select("lang", "p.*")
        return pairs.groupBy("lang", "a", "b", "x", "y").agg(F.count(F.lit(1)).alias("m"))

    def histograms(self) -> DataFrame:
        """``lang, a, b, x, y, m``: every cell of every pair's joint histogram, implied zero cells included; m > 0."""
        pairs = self._pairs()
        zero = F.lit(0).cast("long")

        def cell(x: Column, y: Column, m: Column) -> Column:
            return F.struct(x.alias("x"), y.alias("y"), m.alias("m"))

        x, y, m = F.col("x"), F.col("y"), F.col("m")
        shared = self._shared().select("lang", "a", "b", F.explode(F.array(cell(x, y, m), cell(x, zero, -m), cell(zero, y, -m), cell(zero, zero, m))).alias("c"))
        own = cut(self.entries.groupBy("lang", "source", F.col("n").alias("c")).agg(F.count(F.lit(1)).alias("h")))
        c, h = F.col("c"), F.col("h")
        parts = [shared.select("lang", "a", "b", "c.*"), pairs.select("lang", "a", "b", zero.alias("x"), zero.alias("y"), F.col("v").alias("m"))]
        for side, edge in (("a", cell(c, zero, h)), ("b", cell(zero, c, h))):
            met = pairs.select("lang", "a", "b").join(own.withColumnRenamed("source", side), ["lang", side])
            parts.append(met.select("lang", "a", "b", F.explode(F.array(edge, cell(zero, zero, -h))).alias("e")).select("lang", "a", "b", "e.*"))
        cells = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
        cells = cells.groupBy("lang", "a", "b", "x", "y").agg(F.sum("m").alias("m")).filter("m > 0")
        return cells.join(pairs, ["lang", "a", "b"], "right")

    def pairs(self) -> DataFrame:
        """``lang, source, item, value``: how far each other source of the language is."""
        v = F.col("v")
        f = F.abs(_share(F.col("x"), F.col("total_a"), v) - _share(F.col("y"), F.col("total_b"), v))
        value = F.coalesce(F.sum(F.when(v > 0, F.col("m") * f)), F.lit(0)).cast("long")
        sums = self.histograms().groupBy("lang", "a", "b").agg(value.alias("value"))
        ways = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))
        return sums.select("lang", F.explode(ways).alias("w"), "value").select("lang", "w.*", "value")

    def terms(self) -> DataFrame:
        """``lang, source, item, value``: terms that a source uses more than its language, and by how much."""
        met = self.entries.join(self.groups, ["lang", "source"])
        p, q = _share(F.col("n"), F.col("total"), F.col("v")), _share(F.col("lang_n"), F.col("lang_total"), F.col("v"))
        return met.select("lang", "source", F.col("term").alias("item"), (p - q).cast("long").alias("value")).filter("value > 0")


def audit(docs: DataFrame, documents: int = 30, top: int = 50) -> DataFrame:
    """``lang, source, part, item, value, rank``: part ``pair`` whole, part ``term`` to rank ``top``."""
    a = Audit(docs, documents)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")

    def ranked(df: DataFrame, part: str) -> DataFrame:
        return df.withColumn("rank", F.row_number().over(order)).select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")

    return ranked(a.pairs(), "pair").unionByName(ranked(a.terms(), "term").filter(F.col("rank") <= top))


def oracle(documents: int = 30, top: int = 50) -> str:
    letters = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    share = "1 + ({unit}::HUGEINT * ({n} + {s})) // ({total} + {s} * v)"
    p = lambda n, total: share.format(unit=UNIT, s=SMOOTH, n=n, total=total)
    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                      regexp_extract_all(translate(coalesce(text, ''), {letters}), '{TERM}') AS a FROM documents),
    o AS (SELECT r, lang, source, unnest(a) AS term FROM d),
    kept AS (SELECT lang, term, count(*) AS lang_n FROM o GROUP BY ALL HAVING count(DISTINCT r) >= {documents}),
    l AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM kept GROUP BY ALL),
    c AS (SELECT lang, source, term, count(*) AS n, any_value(lang_n) AS lang_n FROM o JOIN kept USING (lang, term) GROUP BY ALL),
    g AS (SELECT lang, source, coalesce(total, 0) AS total, coalesce(v, 0) AS v, coalesce(lang_total, 0) AS lang_total
          FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL) USING (lang, source) LEFT JOIN l USING (lang)),
    every AS (SELECT g.lang, g.source, kept.term, {p('coalesce(n, 0)', 'total')} AS p
              FROM g JOIN kept ON g.lang = kept.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
    sums AS (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value
             FROM every x JOIN every y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
    pairs AS (SELECT x.lang, x.source, y.source AS item, coalesce(value, 0) AS value
              FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source
              LEFT JOIN sums s ON s.lang = x.lang AND s.source = x.source AND s.item = y.source),
    terms AS (SELECT lang, source, term AS item, ({p('n', 'total')}) - ({p('lang_n', 'lang_total')}) AS value FROM c JOIN g USING (lang, source)),
    ranked AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM terms WHERE value > 0)
    SELECT lang, source, part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank
    FROM ranked QUALIFY part = 'pair' OR rank <= {top}"""
