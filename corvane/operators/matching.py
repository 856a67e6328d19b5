"""Candidates against jobs: skills by name and by vector, greedy one-to-one assignment, full scores."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import scoring as C
from corvane.operators.rows import keep_top


def similar_skills(have: DataFrame, want: DataFrame, vectors: DataFrame, least: float = 0.65) -> DataFrame:
    """``candidate, job, wanted, had, sim``: pairs of skill vectors with cosine above ``least``, within a candidate and job that meet.

    ``have(candidate, job, skill)`` and ``want(job, skill)`` are joined on the job, so only skills of one
    application are compared; vectors are joined once to each side with their lengths.
    """
    # vectors move with each line in their own type, and are made double where they are multiplied
    v = vectors.select("skill", "vector")
    v = v.withColumn("size", F.sqrt(C.dot(F.col("vector"), F.col("vector"))))  # once a vector, not once a pair
    a = have.join(v, "skill").select("candidate", "job", F.col("skill").alias("had"), F.col("vector").alias("a"), F.col("size").alias("size_a"))
    b = want.join(v, "skill").select("job", F.col("skill").alias("wanted"), F.col("vector").alias("b"), F.col("size").alias("size_b"))
    cosine = F.try_divide(C.dot(F.col("a"), F.col("b")), F.col("size_a") * F.col("size_b"))
    pairs = a.join(b, "job").withColumn("sim", F.when(F.col("had") == F.col("wanted"), 1.0).otherwise(cosine))
    return pairs.filter(F.col("sim") > least).select("candidate", "job", "wanted", "had", "sim")


def _matrix(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Components of all vectors in a row, where each begins, and its length; -1 for a vector that is null or holds a null."""
    lists = pa.concat_arrays([c.cast(pa.large_list(pa.float64())) for c in column.chunks]) if column.num_chunks else pa.array([], pa.large_list(pa.float64()))
    sizes = np.array(pc.fill_null(pc.list_value_length(lists), -1))
    begins = np.concatenate([[0], np.cumsum(np.maximum(sizes, 0))])
    values = lists.flatten()
    if values.null_count:
        at = np.flatnonzero(np.array(pc.is_null(values)))
        sizes[np.searchsorted(begins, at, side="right") - 1] = -1
    return values.to_numpy(zero_copy_only=False), begins[:-1], sizes


def _nearest_in(k: int, names: list[str]):
    def run(asked: pa.Table, rows: pa.Table) -> pa.Table:
        """Each asked row's k of the block: cosines as products of matrices, then those that may count again, each pair for itself."""
        keys, others = np.array(asked.column(0).to_pylist(), object), np.array(rows.column(0).to_pylist(), object)
        order = np.argsort(others, kind="stable")
        picks: list[tuple[int, int, float | None]] = []
        (va, at_a, len_a), (vb, at_b, len_b) = _matrix(asked.column(2)), _matrix(rows.column(2))
        for size in np.unique(len_a):
            mine = np.flatnonzero(len_a == size)
            pool = order[len_b[order] == size] if size >= 0 else order[:0]  # by name; vectors of other lengths have no cosine
            wide = max(int(size), 0)
            b = vb[at_b[pool][:, None] + np.arange(wide)]
            with np.errstate(all="ignore"):
                size_b = np.sqrt((b * b).sum(axis=1))
                for cut in range(0, len(mine), 256):
                    part = mine[cut : cut + 256]
                    a = va[at_a[part][:, None] + np.arange(wide)] if size >= 0 else np.zeros((len(part), 0))
                    size_a = np.sqrt((a * a).sum(axis=1))
                    near = a @ b.T
                    for i, row in enumerate(part.tolist()):
                        lengths = size_a[i] * size_b
                        usable = (lengths != 0) & (others[pool] != keys[row])
                        v = np.where(usable, near[i] / lengths, -np.inf)
                        v[np.isnan(v)] = np.inf  # NaN comes first, as Spark sorts it
                        n = min(k, int(usable.sum()))
                        if n:
                            at = np.flatnonzero(usable & (v >= np.partition(v, len(v) - n)[len(v) - n] - 1e-8))
                            sim = np.round((a[i] * b[at]).sum(axis=1) / lengths[at], 9)
                            first = np.argsort(np.where(np.isnan(sim), -np.inf, -sim), kind="stable")[:n]
                            picks += [(row, int(pool[at[j]]), float(sim[j])) for j in first.tolist()]
                        if n < k:
                            taken = set(pool[usable].tolist())
                            rest = (j for j in order.tolist() if j not in taken and others[j] != keys[row])
                            picks += [(row, j, None) for j in islice(rest, k - n)]
        cols = list(zip(*picks, strict=True)) or [(), (), ()]
        pick = lambda column, at: column.take(pa.array(at, pa.int64()))
        return pa.table([pick(asked.column(0), cols[0]), pick(rows.column(0), cols[1]), pa.array(cols[2], pa.float64())], names=names)

    return run


def nearest_within(asked: DataFrame, rows: DataFrame, key: str, group: str, vector: str, k: int, block: int = 20_000) -> DataFrame:
    """``key, other, sim``: for each row asked the ``k`` rows of its group with the highest cosine (the smaller key in a tie; rows
    without one, such as null and zero vectors, last).

    Large groups are dealt into blocks of about ``block`` rows, met by parts of about 4,096 asked rows; each meeting is a product of two
    matrices and gives its own ``k``, so no task holds a whole group and no more than ``k`` rows a block are shuffled on.
    """
    here = asked.filter(F.col(key).isNotNull())
    sizes = rows.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("_blocks"))
    sizes = sizes.join(here.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / F.lit(4096)).cast("int").alias("_parts")), group)
    own = lambda n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = here.join(sizes, group).select(F.col(key), F.col(group).alias("_g"), F.col(vector).alias("_a"), every("_blocks").alias("_block"), own("_parts").alias("_part"))
    b = rows.filter(F.col(key).isNotNull()).join(sizes, group).select(F.col(key).alias("other"), F.col(group).alias("_h"), F.col(vector).alias("_b"), own("_blocks").alias("_row_block"), every("_parts").alias("_row_part"))
    met = a.groupBy("_g", "_block", "_part").cogroup(b.groupBy("_h", "_row_block", "_row_part"))
    kind = rows.schema[key].dataType.simpleString()
    pairs = met.applyInArrow(_nearest_in(k, [key, "other", "sim"]), f"{key} {kind}, other {kind}, sim double")
    return keep_top(pairs, [key], k, F.desc("sim"), F.col("other"))


def assign(pairs: DataFrame) -> DataFrame:
    """Each wanted skill, in name order, takes the most similar one not yet taken (first by name in a tie).

    The choice depends on earlier ones, so the pairs of a candidate and job, whose number a person's list bounds and not the
    table, are one sorted array, folded on the JVM.  Equal pairs count once.
    """
    pick = "struct<wanted:string,had:string,sim:double>"

    def step(acc: Column, x: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)  # picks stand in the order of wanted skills
        free = ~F.coalesce(last["wanted"] == x["wanted"], F.lit(False)) & ~F.exists(acc, lambda p: p["had"] == x["had"])
        return F.when(free, F.concat(acc, F.array(F.struct(x["wanted"].alias("wanted"), x["had"].alias("had"), (-x["far"]).alias("sim"))))).otherwise(acc)

    ordered = F.array_sort(F.collect_list(F.struct("wanted", (-F.col("sim")).alias("far"), "had")))
    own = pairs.groupBy("candidate", "job").agg(ordered.alias("p"))
    return own.select("candidate", "job", F.inline(F.aggregate("p", F.expr(f"cast(array() as array<{pick}>)"), step)))


def skill_parts(have: Column, required: Column, preferred: Column, near_required: Column | None = None) -> tuple[Column, Column]:
    """Shares of required and preferred skills: 1 for an equal name, 0.85 for each near one."""
    part = lambda want, near: F.when(F.size(want) > 0, F.least(F.lit(1.0), (F.size(F.array_intersect(have, want)) + near * 0.85) / F.size(want))).otherwise(F.lit(1.0))
    return part(required, F.lit(0) if near_required is None else near_required), part(preferred, F.lit(0))


def explain_skills(have: Column, want: Column) -> Column:
    """``matching, missing, extra``."""
    return F.struct(F.array_intersect(have, want).alias("matching"), F.array_except(want, have).alias("missing"), F.array_except(have, want).alias("extra"))


def project_score(text: Column, skills: Sequence[str]) -> Column:
    """40 without text, 50 without skills, else the share of the first ten skills that the text holds."""
    first = list(skills)[:10]
    if not first:
        return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 40.0).otherwise(50.0)
    hits = sum((F.lower(text).contains(s.lower()).cast("int") for s in first), F.lit(0))
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 40.0).otherwise(F.round(hits * 100.0 / len(first), 1))


def role_score(title: Column, wanted: str) -> Column:
    """100 when the roles match, else the share of the wanted role's words times 60."""
    from corvane.functions.strings import role_key, role_match

    words = F.split(role_key(F.lit(wanted)), " ")
    share = F.size(F.array_intersect(F.split(role_key(title), " "), words)) / F.size(words)
    return F.when(role_match(title, F.lit(wanted)), 100.0).otherwise(F.round(share * 60, 1))


def certification_score(text: Column, certificates: Column, wanted: Column) -> Column:
    """100 where none is wanted; else a point for each wanted one that the text holds and one for each that a certificate holds, as
    a share of those wanted, 100 at most."""
    held = lambda w: F.exists(F.coalesce(certificates, F.array().cast("array<string>")), lambda c: F.contains(F.lower(c), F.lower(w)))
    points = F.aggregate(wanted, F.lit(0), lambda n, w: n + F.coalesce(F.contains(F.lower(text), F.lower(w)), F.lit(False)).cast("int") + held(w).cast("int"))
    return F.when(F.coalesce(F.size(wanted), F.lit(0)) <= 0, 100.0).otherwise(F.least(F.lit(100.0), F.round(points * 100.0 / F.size(wanted))))


def location_score(location: Column, wanted: Column) -> Column:
    """100 where no place is wanted, or the place holds a wanted one or is held by it; 0 else, and without a place."""
    place = F.lower(location)
    near = F.exists(wanted, lambda w: F.contains(place, F.lower(w)) | F.contains(F.lower(w), place))
    return F.when(F.coalesce(F.size(wanted), F.lit(0)) <= 0, 100.0).when(F.coalesce(place, F.lit("")) == "", 0.0).otherwise(F.when(near, 100.0).otherwise(0.0))
