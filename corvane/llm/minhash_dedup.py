"""Operator 10. MinHash near-dedup by a signature-coordinate inverted join.

1. Every text becomes its set of distinct word shingles and a MinHash signature of ``coords``
   coordinates.  Texts with equal sets fall into one class; a class acts through one row's key, a hash of id and text.
2. Classes are posted under each (coordinate, value).  Two sets of similarity s agree in a coordinate
   with probability s, so ``matches_needed`` sets the number of agreements T that a pair at the
   threshold misses with probability under 1e-9.
3. Skip: a value that one class alone holds cannot count, and a class with fewer than T shared values
   cannot reach T, so its lists are never merged.  Prefix: of a class's values, ordered by how many
   classes share them, the rarest (coords - T + 1) suffice to meet every class it has T in common with.
4. Collisions are counted within each prefix list.  Long lists are cut into blocks, every pair of
   blocks is one piece of work, and a piece returns a spanning forest, never all pairs.
5. The families so found are checked on full shingle sets by integer comparison.  First every member is compared with
   its family's pivot, the one with most candidate links; what links to it is settled.  The others are compared with each
   other and with all members, by blocks, so that members of one settled group are never paired.  Components of the
   confirmed links give the groups.

Defined cases: null or blank text has no shingles, n_shingles 0 and links with nothing; a text shorter
than a shingle is one shingle.  Rows that repeat a doc_id each get a row, and each goes by its own text.  A null
doc_id never names a group that holds an id.  ``kept`` marks one row of each group, the one with the smallest id, then key (and rows
equal to it in id and text); ``keep_one`` goes by it.  Columns other than the id and the text are ignored.  An empty table gives an empty
result.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm._common import WORD, binary_rows, block_pairs, cut, group_starts, list_rows, local_forest, slices, whole_groups
from corvane.llm.components import components
from corvane.llm.wordhash import minhash, mix64, shingles

#: Classes in a block of one posting list, members in a block compared with a pivot, and texts in a block of a family's rest.
LIST_BLOCK, STAR_BLOCK, FAMILY_BLOCK = 1024, 384, 192


def matches_needed(similarity: float, coords: int, miss: float = 1e-9) -> int:
    """The largest T such that a pair at ``similarity`` has fewer than T agreements with probability under ``miss``."""
    below = 0.0
    for t in range(coords):
        below += comb(coords, t) * similarity**t * (1 - similarity) ** (coords - t)
        if below > miss:
            return max(1, t)
    return coords


def _signatures(words: int, coords: int):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                values, sizes = shingles(part.column(1).to_pylist(), words)
                a, b = _set_key(values, sizes)
                sig = minhash(values, sizes, coords)
                has = np.where(sizes > 0, coords, 0)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(sizes), pa.array(a), pa.array(b), list_rows(sig[sizes > 0].view(np.int32).ravel(), has, pa.int32())],
                    ["doc_id", "row_key", "n_shingles", "set_a", "set_b", "sig"],
                )

    return run


def _set_key(values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums of mixed members: equal for equal sets."""
    out = [np.zeros(len(sizes), dtype=np.uint64), np.zeros(len(sizes), dtype=np.uint64)]
    full = np.flatnonzero(sizes)
    if len(full):
        starts = (np.cumsum(sizes) - sizes)[full]
        with np.errstate(over="ignore"):
            for o, salt in zip(out, (0x51ED270B0A1F39C1, 0x2545F4914F6CDD1D), strict=True):
                o[full] = np.add.reduceat(mix64(values ^ np.uint64(salt)), starts)
    return out[0].view(np.int64), out[1].view(np.int64)


def _list_links(need: int):
    """Links of each posting list's block: pairs of classes that agree in ``need`` coordinates, as a forest."""
    keys = ["key", "blk_p", "blk_q"]

    def run(batches):
        for tab in whole_groups(batches, keys):
            bounds = group_starts(tab, keys)
            rep = tab.column("rep").to_numpy()
            sig = tab.column("sig").combine_chunks()
            sig = sig.values.to_numpy()[sig.offsets[0].as_py() : sig.offsets[-1].as_py()].reshape(tab.num_rows, -1)
            sizes = np.diff(bounds)
            found_a, found_b = [], []
            # short lists together, by length; long ones row by row
            for n in np.unique(sizes):
                starts = bounds[:-1][sizes == n]
                if n == 1:
                    continue
                if n <= 48:
                    i, j = np.triu_indices(n, 1)
                    for s in range(0, len(starts), max(1, 65536 // len(i))):
                        some = starts[s : s + max(1, 65536 // len(i)), None]
                        x, y = (some + i).ravel(), (some + j).ravel()
                        hit = (sig[x] == sig[y]).sum(1) >= need
                        found_a.append(x[hit])
                        found_b.append(y[hit])
                else:
                    for s in starts:
                        block = np.ascontiguousarray(sig[s : s + n].T)
                        count = np.zeros((n, n), dtype=np.uint8 if len(block) < 256 else np.uint16)
                        for row in block:
                            count += row[:, None] == row[None, :]
                        x, y = np.nonzero(np.triu(count >= need, 1))
                        label = local_forest(n, x, y)
                        own = np.flatnonzero(label != np.arange(n))
                        found_a.append(s + own)
                        found_b.append(s + label[own])
            if found_a:
                a, b = rep[np.concatenate(found_a)], rep[np.concatenate(found_b)]
                off = a != b
                if off.any():
                    pairs = np.unique(np.stack([np.maximum(a, b)[off], np.minimum(a, b)[off]], 1), axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return run


def _sets(words: int):
    def run(batches):
        for batch in batches:
            names = batch.schema.names
            for part in slices(batch, "text"):
                values, sizes = shingles(part.column(names.index("text")).to_pylist(), words)
                a, _ = _set_key(values, sizes)
                same = pa.array(a == part.column(names.index("set_a")).to_numpy())
                out = pa.RecordBatch.from_arrays([part.column(names.index("rep")), part.column(names.index("root")), part.column(names.index("family")), part.column(names.index("pivot")), binary_rows(values, sizes)], ["rep", "root", "family", "pivot", "values"])
                yield out.filter(same)

    return run


def _with_pivot(percent: int):
    """Members of each block whose shingle sets reach ``percent`` of the pivot's, with the pivot."""
    keys = ["root", "blk"]

    def run(batches):
        for tab in whole_groups(batches, keys):
            bounds = group_starts(tab, keys)
            rep, lead = tab.column("rep").to_numpy(), tab.column("pivot").to_numpy()
            cells = tab.column("values").to_pylist()
            out_a, out_b = [], []
            for s, e in zip(bounds[:-1], bounds[1:], strict=True):
                centre = int(np.flatnonzero(rep[s:e] == lead[s:e])[0]) + s
                values = np.frombuffer(cells[centre], dtype=np.uint64)
                others = [i for i in range(s, e) if rep[i] != lead[i]]
                if not others:
                    continue
                sets = [np.frombuffer(cells[i], dtype=np.uint64) for i in others]
                size = np.array([len(x) for x in sets])
                every = np.concatenate(sets)
                at = np.minimum(np.searchsorted(values, every), len(values) - 1)
                inter = np.add.reduceat((values[at] == every).astype(np.int64), np.cumsum(size) - size)
                near = np.flatnonzero(100 * inter >= percent * (size + len(values) - inter))
                out_a.append(rep[np.array(others)[near]])
                out_b.append(np.full(len(near), rep[centre]))
            if out_a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], ["a", "b"])

    return run


def _confirmed(percent: int):
    """Links of each family block whose shingle sets reach ``percent``: 100 * |A and B| >= percent * |A or B|."""
    keys = ["root", "blk_p", "blk_q"]

    def run(batches):
        for tab in whole_groups(batches, keys):
            bounds = group_starts(tab, keys)
            rep = tab.column("rep").to_numpy()
            cells = tab.column("values").to_pylist()
            out_a, out_b = [], []
            for s, e in zip(bounds[:-1], bounds[1:], strict=True):
                if e - s < 2:
                    continue
                sets = [np.frombuffer(c, dtype=np.uint64) for c in cells[s:e]]
                size = np.array([len(x) for x in sets])
                inter = _intersections(sets, size)
                union = size[:, None] + size[None, :] - inter
                x, y = np.nonzero(np.triu(100 * inter >= percent * union, 1))
                label = local_forest(e - s, x, y)
                own = np.flatnonzero(label != np.arange(e - s))
                out_a.append(rep[s + own])
                out_b.append(rep[s + label[own]])
            if out_a:
                a, b = np.concatenate(out_a), np.concatenate(out_b)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run


def _intersections(sets: list[np.ndarray], size: np.ndarray) -> np.ndarray:
    """Intersection sizes of all pairs, through a 0/1 matrix of members that two sets or more share."""
    n = len(sets)
    owner = np.repeat(np.arange(n), size)
    _, member, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.cumsum(count > 1) - 1
    shared = count[member] > 1
    owner, member = owner[shared], column[member[shared]]
    order = np.argsort(member, kind="stable")
    owner, member = owner[order], member[order]
    inter = np.zeros((n, n), dtype=np.float64)
    width = 4096
    for first in range(0, int(member[-1]) + 1 if len(member) else 0, width):
        lo, hi = np.searchsorted(member, [first, first + width])
        m = np.zeros((n, width), dtype=np.float32)
        m[owner[lo:hi], member[lo:hi] - first] = 1
        inter += m @ m.T
    return inter.astype(np.int64)


def _row_key(doc_id: Column, text: Column) -> Column:
    """Rows of one id and one text are one row; nulls have hashes of their own."""
    return F.xxhash64(doc_id.cast("long"), text.cast("string"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, coords: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, row_key, n_shingles, component_id, kept``.

    Texts link when 100 * |A and B| >= ``percent`` * |A or B| over their ``words``-word shingle sets.
    component_id is the smallest id reachable over links; kept are the rows of one id and text of each component, and those without shingles.
    """
    need = matches_needed(percent / 100, coords)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    source = source.withColumn("row_key", _row_key(F.col("doc_id"), F.col("text")))
    base = cut(source.mapInArrow(_signatures(words, coords), "doc_id long, row_key long, n_shingles long, set_a long, set_b long, sig array<int>"))
    # a class of equal sets acts through its row of the smallest id; nulls come last
    first = F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "row_key", "sig"))
    classes = base.filter("n_shingles > 0").groupBy("set_a", "set_b", "n_shingles").agg(first.alias("m"))
    classes = cut(classes.select("set_a", "set_b", "n_shingles", F.col("m.row_key").alias("rep"), F.col("m.doc_id").alias("low"), F.col("m.sig").alias("sig")))
    posted = classes.select("rep", F.posexplode("sig")).select("rep", (F.col("pos") * F.lit(1 << 32) + F.col("col")).alias("key"))
    shared = posted.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    lists = posted.join(shared, "key").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("l")).filter(F.size("l") >= need)
    prefix = lists.select("rep", F.inline(F.slice("l", F.lit(1), F.size("l") - (need - 1))))
    prefix = block_pairs(prefix.join(classes.select("rep", "sig"), "rep"), "n", "rep", LIST_BLOCK)
    keys = ["key", "blk_p", "blk_q"]
    links = cut(prefix.select(*keys, "rep", "sig").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_list_links(need), "a long, b long").distinct())
    families = components(links, "a", "b")
    members = families.union(families.select(F.col("root").alias("node"), "root").distinct())
    ends = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("links"))
    members = members.join(ends, "node").select(F.col("node").alias("rep"), "root", "links")
    heads = members.groupBy("root").agg(F.count(F.lit(1)).alias("family"), F.max(F.struct("links", "rep"))["rep"].alias("pivot"))
    members = cut(members.join(heads, "root").join(classes.select("rep", "set_a"), "rep").select(F.col("rep").alias("row_key"), "root", "family", "pivot", "set_a"))
    texts = source.join(members.hint("merge"), "row_key").select(F.col("row_key").alias("rep"), "root", "family", "set_a", "text", "pivot")
    sets = cut(texts.mapInArrow(_sets(words), "rep long, root long, family long, pivot long, values binary").dropDuplicates(["rep"]))
    # members with their pivot
    blocks = F.ceil(F.col("family") / F.lit(STAR_BLOCK)).cast("int")
    own = F.array(F.pmod(F.xxhash64("rep"), blocks).cast("int"))
    stars = sets.withColumn("blk", F.explode(F.when(F.col("rep") == F.col("pivot"), F.sequence(F.lit(0), blocks - 1)).otherwise(own)))
    keys = ["root", "blk"]
    near = cut(stars.select(*keys, "rep", "pivot", "values").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_with_pivot(percent), "a long, b long"))
    # the rest with each other and with all of their family
    settled = near.select(F.col("a").alias("rep"), F.lit(False).alias("rest"))
    state = members.select(F.col("row_key").alias("rep"), "root", "pivot").join(settled, "rep", "left").withColumn("rest", F.coalesce("rest", F.col("rep") != F.col("pivot")))
    counts = state.groupBy("root").agg(F.count_if("rest").alias("n_rest"), F.count_if(~F.col("rest")).alias("n_near")).filter("n_rest > 0")
    state = cut(state.join(counts, "root").select("rep", "rest", F.ceil(F.col("n_rest") / FAMILY_BLOCK).cast("int").alias("rests"), F.ceil(F.col("n_near") / FAMILY_BLOCK).cast("int").alias("nears")))
    mine = F.pmod(F.xxhash64("rep"), F.when(F.col("rest"), F.col("rests")).otherwise(F.col("nears"))).cast("int")
    mine = F.when(F.col("rest"), mine).otherwise(F.col("rests") + mine)
    met = F.when(F.col("rest"), F.sequence(F.lit(0), F.col("rests") + F.col("nears") - 1)).otherwise(F.sequence(F.lit(0), F.col("rests") - 1))
    state = state.withColumn("mine", mine).withColumn("other", F.explode(met)).select("rep", F.least("mine", "other").alias("blk_p"), F.greatest("mine", "other").alias("blk_q"))
    keys = ["root", "blk_p", "blk_q"]
    pieces = sets.select("rep", "root", "values").join(state, "rep").select(*keys, "rep", "values").repartition(*keys).sortWithinPartitions(*keys)
    confirmed = near.union(pieces.mapInArrow(_confirmed(percent), "a long, b long"))
    groups = components(confirmed, "a", "b")
    linked = groups.union(groups.select(F.col("root").alias("node"), "root").distinct()).withColumnRenamed("node", "rep").join(classes.select("rep", "low"), "rep")
    best = linked.groupBy("root").agg(F.min(F.struct(F.isnull("low").alias("none"), "low", "rep")).alias("m"))
    linked = linked.join(best, "root").select("rep", F.col("m.low").alias("of"), F.col("m.rep").alias("stays"))
    named = classes.select("set_a", "set_b", "n_shingles", "rep", "low").join(linked, "rep", "left")
    named = named.select("set_a", "set_b", "n_shingles", F.coalesce("of", "low").alias("of_class"), F.coalesce("stays", "rep").alias("stays"))
    out = base.select("doc_id", "row_key", "n_shingles", "set_a", "set_b").join(named, ["set_a", "set_b", "n_shingles"], "left")
    kept = F.coalesce(F.col("row_key") == F.col("stays"), F.lit(True))
    return out.select("doc_id", "row_key", "n_shingles", F.coalesce("of_class", "doc_id").alias("component_id"), kept.alias("kept"))


def keep_one(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` (all columns) that ``near_duplicates`` keeps, one per id and text; all rows without an id and a word stay."""
    bare = F.col(id_col).isNull() & ~F.coalesce(F.col(text_col).cast("string").rlike(WORD), F.lit(False))
    keys = found.filter("kept").select(F.col("row_key").alias("_row_key")).distinct()
    left = docs.filter(~bare).withColumn("_row_key", _row_key(F.col(id_col), F.col(text_col)))
    left = left.join(keys, "_row_key", "left_semi").dropDuplicates(["_row_key"])
    return left.select(docs.columns).union(docs.filter(bare))
