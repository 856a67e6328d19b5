"""Operator 4. Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

Targets: the mix holds ``share`` times all words.  Sources get it by weight; a target stops at ``cap``
times its source's size and the excess is shared again by weight until none is above.

Copies: a document of a source with ratio r = target / size of the source takes floor(r) whole copies and
one more with probability r - floor(r).  These probabilities are rounded together: two documents exchange
words at random, in a way that keeps both expectations, until one of them is integral; the other meets the
next.  So the words of a source never drift.  Documents are dealt into groups of about ``fan``; each group
leaves one undecided document, and those are grouped by ``fan`` again, up a tree.  The one document of a
source that stays undecided at the root takes its fraction as that part of its words, so that a source ends
within a word of its target.

Defined cases: a null text has size 0 and takes 0; a null source is a source (the last one); rows that
repeat are separate documents; null ids are kept.  Randomness is a hash of the seed, the id and the place in
the tree: reruns agree.  An empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm._common import WORD, cut


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _ranked(stats: DataFrame) -> DataFrame:
    """``stats`` with ``rank`` from 0 by source (code points, null last): ranges are numbered apart, then shifted."""
    spread = cut(stats.repartitionByRange(8, F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()))
    within = spread.withColumn("within", F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())))
    before = spread.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = before.withColumn("shift", F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("part")) - F.col("n")).select("part", "shift")
    return within.join(before, "part").withColumn("rank", F.col("within") - 1 + F.col("shift")).drop("part", "within", "shift")


def targets(stats: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """``source, source_size, rank, target`` of per-source sizes (``source, source_size``)."""
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    s = cut(_ranked(stats).withColumn("weight", w))
    total = s.agg(F.sum("source_size")).first()[0] or 0
    rate = None  # words a unit of weight; None: everything is capped
    capped = F.lit(False)
    while True:
        row = s.agg(
            F.sum(F.when(capped, F.col("source_size") * cap)).alias("fixed"), F.sum(F.when(~capped, F.col("weight"))).alias("w"), F.count_if(capped).alias("n")
        ).first()
        if not row["w"]:
            rate = None
            break
        new = (share * total - (row["fixed"] or 0.0)) / row["w"]
        over = F.col("weight") * new > F.col("source_size") * cap
        more = s.agg(F.count_if(capped | over).alias("n")).first()["n"]
        rate, capped = new, capped | over
        if more == row["n"]:
            break
    own = F.col("source_size") * F.lit(float(cap))
    return s.withColumn("target", own if rate is None else F.when(capped, own).otherwise(F.col("weight") * F.lit(rate))).drop("weight")


def _fold(items: Column) -> Column:
    """Pivotal rounding along an array of (…, size, p, u): ``done`` has p in {0, 1}, ``cur`` is the one left."""
    kind = "struct<id:bigint,nth:bigint,size:bigint,p:double,u:double>"

    def merge(acc: Column, x: Column) -> Column:
        cur = acc["cur"]
        room_i, has_i = (1 - cur["p"]) * cur["size"], cur["p"] * cur["size"]
        room_x, has_x = (1 - x["p"]) * x["size"], x["p"] * x["size"]
        to_i, to_x = F.least(room_i, has_x), F.least(has_i, room_x)
        up = x["u"] * (to_i + to_x) < to_x  # cur gains with probability to_x / (to_i + to_x)
        i_ends = F.when(up, room_i <= has_x).otherwise(has_i <= room_x)
        p_i = F.when(i_ends, F.when(up, 1.0).otherwise(0.0)).otherwise(cur["p"] + F.when(up, to_i).otherwise(-to_x) / cur["size"])
        p_x = F.when(~i_ends, F.when(up, 0.0).otherwise(1.0)).otherwise(x["p"] + F.when(up, -to_i).otherwise(to_x) / x["size"])
        own = F.struct(cur["id"].alias("id"), cur["nth"].alias("nth"), cur["size"].alias("size"), p_i.alias("p"), cur["u"].alias("u"))
        other = F.struct(x["id"].alias("id"), x["nth"].alias("nth"), x["size"].alias("size"), p_x.alias("p"), x["u"].alias("u"))
        ended, stays = F.when(i_ends, own).otherwise(other), F.when(i_ends, other).otherwise(own)
        return F.when(cur.isNull(), F.struct(x.alias("cur"), acc["done"].alias("done"))).otherwise(
            F.struct(stays.alias("cur"), F.concat(acc["done"], F.array(ended)).alias("done"))
        )

    start = F.expr(f"named_struct('cur', cast(null as {kind}), 'done', cast(array() as array<{kind}>))")
    return F.aggregate(items, start, merge)


def _uniform(seed: int, level: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(level), F.col("id"), F.col("nth"), F.col("rank"), F.col("size")), F.lit(1 << 52)) / F.lit(float(1 << 52))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
    fan: int = 64,
    seed: int = 1,
) -> DataFrame:
    """One row per input row: ``doc_id, source, size, nth, source_size, target, taken``; ``nth`` numbers equal rows from 1."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"))
    base = cut(rows.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n")))
    stats = base.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("docs"))
    aims = cut(targets(stats, weights, share, cap))
    keyed = base.select("doc_id", F.col("source").alias("_s"), "size", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("nth"))
    keyed = keyed.join(aims, F.col("_s").eqNullSafe(F.col("source"))).drop("_s")
    ratio = F.when(F.col("source_size") > 0, F.least(F.lit(cap), F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0))
    keyed = cut(keyed.withColumn("whole", F.floor(ratio)).withColumn("part", ratio - F.floor(ratio)))
    fixed = (F.col("size") == 0) | (F.col("part") == 0)
    names = ["doc_id", "source", "size", "nth", "source_size", "target"]
    done = keyed.filter(fixed).select(*names, (F.col("whole") * F.col("size")).cast("long").alias("taken"))
    # source and size too: rows without an id may all be the first of their size
    bucket = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "nth", "source", "size"), F.ceil(F.col("docs") / F.lit(fan)))
    live = keyed.filter(~fixed).select("rank", bucket.alias("bucket"), F.col("doc_id").alias("id"), "nth", "size", F.col("part").alias("p"))
    depth, top = 0, (aims.agg(F.max("docs")).first()[0] or 1)
    decided = None
    while True:
        u = live.withColumn("u", _uniform(seed, depth))
        folded = u.groupBy("rank", "bucket").agg(F.sort_array(F.collect_list(F.struct("u", "id", "nth", "size", "p"))).alias("l"))
        folded = folded.withColumn("l", F.transform("l", lambda x: F.struct(x["id"].alias("id"), x["nth"].alias("nth"), x["size"].alias("size"), x["p"].alias("p"), x["u"].alias("u"))))
        folded = cut(folded.select("rank", "bucket", _fold(F.col("l")).alias("f")))
        ended = folded.select("rank", F.inline("f.done")).select("rank", "id", "nth", "size", "p")
        decided = ended if decided is None else decided.union(ended)
        left = folded.select("rank", "bucket", F.col("f.cur.id").alias("id"), F.col("f.cur.nth").alias("nth"), F.col("f.cur.size").alias("size"), F.col("f.cur.p").alias("p"))
        top = -(-top // fan)
        if top <= 1:
            break
        live, depth = left.withColumn("bucket", F.floor(F.col("bucket") / fan)), depth + 1
    decided = decided.union(left.select("rank", "id", "nth", "size", "p"))
    extra = F.round(F.col("p") * F.col("size")).cast("long")
    at = aims.select("rank", "source", "source_size", "target", F.floor(F.try_divide("target", "source_size")).alias("whole"))
    out = decided.join(at, "rank").select(F.col("id").alias("doc_id"), "source", "size", "nth", "source_size", "target", (F.col("whole") * F.col("size") + extra).alias("taken"))
    return done.union(out)


def resample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself, with the columns of ``docs``: each document as often as it is taken, a last copy cut to its fraction's words.

    Rows without an id go by a hash of all their columns, so that they are not numbered together.
    """
    size, id_, source = (c for c in ("_mix_size", "_mix_id", "_mix_source"))
    row = F.coalesce(F.col(id_col).cast("long"), F.xxhash64(*docs.columns))
    rows = docs.select(*[F.col(c) for c in docs.columns], row.alias(id_), F.col(source_col).cast("string").alias(source), word_count(F.col(text_col)).alias(size))
    got = mix(rows, id_, text_col, source_col, **options).filter("taken > 0")
    got = got.select(F.col("doc_id").alias(id_), F.col("source").alias(source), F.col("size").alias(size), F.col("nth").alias("_mix_nth"), F.col("taken").alias("_mix_taken"))
    rows = rows.withColumn("_mix_nth", F.row_number().over(Window.partitionBy(id_, source, size).orderBy(F.xxhash64(text_col))).cast("long"))
    keys = F.lit(True)
    for c in (id_, source, size, "_mix_nth"):
        keys = keys & rows[c].eqNullSafe(got[c])
    both = rows.join(got, keys).select(*[rows[c] for c in docs.columns], rows[size], got["_mix_taken"])
    words = F.least(F.col(size), F.col("_mix_taken") - F.col("_mix_copy") * F.col(size))
    both = both.withColumn("_mix_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_mix_taken") - 1) / F.col(size)))))
    # the first words with the white space before each
    part = F.array_join(F.slice(F.regexp_extract_all(text_col, F.lit(r"([\x20\x09-\x0D]*" + WORD + ")"), F.lit(1)), F.lit(1), words.cast("int")), "")
    return both.withColumn(text_col, F.when(words == F.col(size), F.col(text_col)).otherwise(part)).select(docs.columns)
