"""Operator 7. Approximate nearest neighbours by multi-index hashing.

Codes: the signs of centred vectors under learned rotations (iterative quantisation of a bounded sample), as many
rotations as the code needs bits.  A code is split into substrings of 16 bits, each with its own inverted index.  With
m substrings and each probed within ``s`` bits, every code within radius m * (s + 1) - 1 is retrieved: by the
pigeonhole principle one of its substrings differs in s bits at most.  All retrieved rows are reranked by exact distance.

m and s are fitted, not set: the exact neighbours of ``asked`` sampled rows are found among all rows, in one pass, and codes
grow until ``target`` of them are retrieved.  Of s = 0, 1, 2, ... the first is taken that gets there with at most ``most`` substrings;
small s makes few strangers share a value.  Clustered vectors need few substrings; for vectors without structure the share of rows
that must be probed is a property of the data (README gives measured shares).

Substrings grow by a bit each time the table doubles beyond 65,536 rows, so that the strangers which share a value stay few.

Every row is indexed.  The index is searched in one of two ways, whichever moves fewer bytes by the share of rows that sampled queries meet:

- as a table of postings (substring, value, row), joined by equality to the values that queries probe; candidates are made distinct as
  numbers, then fetched with their vectors.  What moves grows with the rows and with the candidates, not with rows x queries.
- where a query meets a large share of all rows anyway, by shards of about ``shard_rows`` rows, each with its own index, which answer queries in
  blocks of ``block_rows``; a candidate's vector is then not moved for each query that meets it.

Both find the same rows.  A query that gets fewer than ``k`` this way is compared with all rows, by shards and blocks.

Defined cases: vectors that are null, empty, zero, of unusual length or hold null or non-finite components
take no part, nor do null ids; rows that repeat a query's id are its own, and of those the smallest vector asks; equal
distances go to the smaller id; fewer candidates than k give fewer rows.  Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm._common import cut, drawn, group_starts, list_rows, whole_groups
from corvane.llm.vectors import matrix, most_common_width, usable

#: Bits of a substring.
BITS = 16
FOUND = "query_id long, vec_id long, score double"


def ball(s: int, bits: int = BITS) -> np.ndarray:
    """All differences of at most ``s`` bits."""
    return np.array([sum(1 << b for b in some) for n in range(s + 1) for some in combinations(range(bits), n)], dtype=_kind(bits))


def _kind(bits: int) -> type:
    return np.uint16 if bits <= 16 else np.uint32


def substring_bits(rows: int) -> int:
    """16 bits, and one more each time the table doubles beyond 65,536 rows: strangers that share a value stay few at every size."""
    return min(28, max(BITS, int(rows - 1).bit_length()))


def learn(sample: np.ndarray, rotations: int, seed: int, rounds: int = 10) -> np.ndarray:
    """``rotations`` rotations of a centred sample side by side: each brings it close to its signs."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(rotations):
        r = np.linalg.qr(rng.normal(size=(sample.shape[1],) * 2))[0]
        for _ in range(rounds):
            u, _, vt = np.linalg.svd(np.where(sample @ r > 0, 1.0, -1.0).T @ sample)
            r = (u @ vt).T
        out.append(r)
    return np.concatenate(out, 1)


def encode(x: np.ndarray, centre: np.ndarray, rotation: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Substrings of the codes: (rows, m)."""
    m = rotation.shape[1] // bits
    out = np.empty((len(x), m), dtype=_kind(bits))
    power = 1 << np.arange(bits - 1, -1, -1, dtype=np.int64)
    for at in range(0, len(x), 1024):  # the product of all rows at once would be many times their size
        signs = (x[at : at + 1024] - centre) @ rotation[:, : m * bits] > 0
        out[at : at + 1024] = np.packbits(signs, axis=1).view(">u2") if bits == 16 else signs.reshape(-1, m, bits) @ power
    return out


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of bits in which substrings differ."""
    return np.bitwise_count(a ^ b).astype(np.int64)


def fit(sample: np.ndarray, pairs: tuple[np.ndarray, np.ndarray], target: float, most: int, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, int]:
    """Centre, rotations and s such that ``target`` of the neighbour ``pairs`` meet in a substring."""
    centre, d = sample.mean(0), sample.shape[1]
    rotation, nearest = np.zeros((d, 0)), None
    while True:
        have = rotation.shape[1] // bits
        more = -(-max(32, have) * bits // d)
        rotation = np.concatenate([rotation, learn(sample - centre, more, rotation.shape[1])], 1)
        m = min(most, rotation.shape[1] // bits)
        a, b = (encode(p, centre, rotation[:, : m * bits], bits) for p in pairs)
        nearest = np.minimum.accumulate(_apart(a, b), axis=1)  # the best of the first substrings
        for s in range(2):
            met = (nearest <= s).mean(0) if len(a) else np.ones(m)
            if met[-1] >= target:
                m = int(np.argmax(met >= target)) + 1
                return centre, rotation[:, : m * bits], s
        if m == most:
            break
    for s in range(2, bits + 1):
        met = (nearest <= s).mean(0)
        if met[-1] >= target:
            m = int(np.argmax(met >= target)) + 1
            return centre, rotation[:, : m * bits], s
    raise AssertionError("two substrings differ in all bits at most")


class MultiIndex:
    """An inverted index for each substring of the codes: rows in order of their value."""

    def __init__(self, codes: np.ndarray):
        self.n, m = codes.shape
        self.order = np.argsort(codes, axis=0, kind="stable").T.astype(np.int32)
        # one sorted list over all substrings: the substring's number above its value
        self.keys = (np.take_along_axis(codes.T, self.order, 1).astype(np.int64) + (np.arange(m, dtype=np.int64) << 32)[:, None]).ravel()
        self.order = self.order.ravel()

    def probe(self, code: np.ndarray, near: np.ndarray) -> np.ndarray:
        """All rows with a substring that differs from the code's by one of ``near``."""
        at = ((code[:, None] ^ near[None, :]).astype(np.int64) + (np.arange(len(code), dtype=np.int64) << 32)[:, None]).ravel()
        lo, hi = np.searchsorted(self.keys, at, "left"), np.searchsorted(self.keys, at, "right")
        some = np.flatnonzero(hi > lo)
        lo, n = lo[some], (hi - lo)[some]
        hit = np.zeros(self.n, dtype=bool)
        hit[self.order[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]] = True
        return np.flatnonzero(hit)


def _nearest_of(q: int, v: np.ndarray, rows: np.ndarray, ids: np.ndarray, base: np.ndarray, k: int):
    """The k nearest of ``rows`` but those of the query's id; ties go to the smaller id."""
    rows = rows[ids[rows] != q]
    d = np.sqrt(((base[rows] - v) ** 2).sum(1))
    if len(rows) > 4 * k:
        some = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])
        rows, d = rows[some], d[some]
    best = np.lexsort((ids[rows], d))[:k]
    return np.full(len(best), q), ids[rows[best]], d[best]


def _search(fitted, k: int, width: int):
    """Answers of each (shard, block), by the index or, without ``fitted``, from all rows of the shard."""
    group = ["shard", "block"]

    def run(batches):
        for tab in whole_groups(batches, group):
            bounds = group_starts(tab, group)
            for s, e in zip(bounds[:-1], bounds[1:], strict=True):
                part = tab.slice(s, e - s)
                query = part.column("query").to_numpy().astype(bool)
                ids, x = part.column("vec_id").to_numpy(), matrix(part.column("embedding"), width)
                base_ids, base = ids[~query], x[~query]
                if len(base_ids) == 0 or not query.any():
                    continue
                everything, out = np.arange(len(base_ids)), []
                if fitted:
                    centre, rotation, s_bits, bits = fitted
                    index, codes, near = MultiIndex(encode(base, centre, rotation, bits)), encode(x[query], centre, rotation, bits), ball(s_bits, bits)
                for i, (q, v) in enumerate(zip(ids[query], x[query], strict=True)):
                    out.append(_nearest_of(q, v, index.probe(codes[i], near) if fitted else everything, base_ids, base, k))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["query_id", "vec_id", "score"])

    return run


def _exact(ids: np.ndarray, x: np.ndarray, k: int, width: int):
    """Each task's nearest rows of a few queries, with their vectors."""

    def run(batches):
        for batch in batches:
            base_ids, base = batch.column(0).to_numpy(), matrix(batch.column(1), width)
            for q, v in zip(ids, x, strict=True):
                _, near, d = _nearest_of(q, v, np.arange(len(base_ids)), base_ids, base, k)
                at = np.searchsorted(base_ids, near, sorter=(order := np.argsort(base_ids, kind="stable")))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(near), q)), pa.array(near), pa.array(d), batch.column(1).take(pa.array(order[at]))], ["query_id", "vec_id", "score", "embedding"])

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k nearest rows of each query; rows that repeat an id count once each."""
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))).filter(F.col("rank") <= k)


def _pieces(rows: DataFrame, asks: DataFrame, shards: int, blocks: int) -> DataFrame:
    base = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(False).alias("query"), "vec_id", "embedding")
    asks = asks.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), F.lit(True).alias("query"), "vec_id", "embedding")
    return base.union(asks).repartition(shards * blocks, "shard", "block").sortWithinPartitions("shard", "block")


def fit_index(rows: DataFrame, width: int, total: int, k: int = 10, sample: int = 4096, asked: int = 96, target: float = 0.97, most: int = 512) -> tuple[tuple[np.ndarray, np.ndarray, int, int], float]:
    """Codes of ``rows`` (``vec_id, embedding``): learnt from ``sample`` rows, fitted to the exact neighbours, among all rows, of ``asked``;
    and the share of rows that a query meets, among the sampled ones."""
    some = drawn(rows.select("vec_id", "embedding"), "vec_id", sample, total).sort("vec_id", "embedding").toArrow()
    x, ids = matrix(some.column("embedding"), width), some.column("vec_id").to_numpy()
    ids, at = np.unique(ids[:: max(1, -(-len(ids) // asked))], return_index=True)
    at *= max(1, -(-len(x) // asked))
    near = rows.select("vec_id", "embedding").mapInArrow(_exact(ids, x[at], k, width), FOUND + ", embedding array<double>")
    near = _best(near, k).select("query_id", "embedding").toArrow()  # at most asked * k rows
    asks = x[at][np.searchsorted(ids, near.column("query_id").to_numpy())]
    bits = substring_bits(total)
    centre, rotation, s = fit(x, (asks, matrix(near.column("embedding"), width)), target, most, bits)
    index, codes = MultiIndex(encode(x, centre, rotation, bits)), encode(x[at], centre, rotation, bits)
    met = sum(len(index.probe(c, ball(s, bits))) for c in codes)
    return (centre, rotation, s, bits), max(1, met) / max(1, len(x) * len(codes))


def _posted(fitted, width: int):
    """Adds the substrings of each row's code."""
    centre, rotation, _, bits = fitted

    def run(batches):
        for batch in batches:
            codes = encode(matrix(batch.column(1), width), centre, rotation, bits)
            yield pa.RecordBatch.from_arrays([batch.column(0), list_rows(codes.ravel().astype(np.int32), np.full(len(codes), codes.shape[1]), pa.int32())], ["row", "code"])

    return run


def _distances(width: int):
    def run(batches):
        for batch in batches:
            a, b = (matrix(batch.column(batch.schema.get_field_index(c)), width) for c in ("asked", "embedding"))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.sqrt(((b - a) ** 2).sum(1)))], ["query_id", "vec_id", "score"])

    return run


def _by_postings(rows: DataFrame, asks: DataFrame, fitted, width: int) -> DataFrame:
    """The index as a table: a posting for each row and substring, joined by equality to the values that each query probes; candidates are
    numbers until they are distinct, then each meets the two vectors once."""
    differences = F.array(*[F.lit(int(d)) for d in ball(*fitted[2:])])
    postings = rows.select("row", "embedding").mapInArrow(_posted(fitted, width), "row long, code array<int>").select("row", F.posexplode("code").alias("place", "value"))
    probes = asks.select("vec_id", "embedding").mapInArrow(_posted(fitted, width), "row long, code array<int>").select(F.col("row").alias("query_id"), F.posexplode("code").alias("place", "own"))
    probes = probes.select("query_id", "place", F.explode(F.transform(differences, lambda d: F.col("own").bitwiseXOR(d))).alias("value"))
    pairs = postings.join(probes, ["place", "value"]).select("query_id", "row").distinct()
    met = pairs.join(rows.select("row", "vec_id", "embedding"), "row").filter("vec_id <> query_id")
    met = met.join(asks.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("asked")), "query_id").select("query_id", "vec_id", "asked", "embedding")
    return met.mapInArrow(_distances(width), FOUND)


def search(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    sample: int = 4096,
    asked: int = 96,
    target: float = 0.97,
    most: int = 512,
    shard_rows: int = 16_384,
    block_rows: int = 65_536,
    plan: str | None = None,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row where ``is_query`` its ``k`` nearest others found, by Euclidean distance.

    ``plan`` is ``shards`` or ``postings``; without one the cheaper by what each would move.  Both read the same index and give the same rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("embedding"), is_query.cast("boolean").alias("query"))
    rows = cut(rows.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).withColumn("row", F.monotonically_increasing_id()))
    width = most_common_width(rows, "embedding")
    rows = rows.filter(F.size("embedding") == width)
    total, queries = rows.agg(F.count(F.lit(1)), F.count_if("query")).first()
    if not queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shards, blocks = -(-total // shard_rows), -(-queries // block_rows)
    asks = rows.filter("query").groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    fitted, share = fit_index(rows, width, total, k, sample, asked, target, most)
    if plan is None:
        vector, posts = 8 * width, fitted[1].shape[1] // fitted[3] * total
        moved = {"shards": (total * blocks + queries * shards) * vector, "postings": 24 * posts + share * total * queries * (2 * vector + 16)}
        plan = min(moved, key=moved.get)
    if plan == "shards":
        found = _pieces(rows, asks, shards, blocks).mapInArrow(_search(fitted, k, width), FOUND)
    else:
        found = _by_postings(rows, asks, fitted, width)
    best = cut(_best(found, k))
    lack = asks.join(best.filter(F.col("rank") == k).withColumnRenamed("query_id", "vec_id"), "vec_id", "left_anti")
    left = lack.count()
    if left:
        rest = _pieces(rows, lack, shards, -(-left // block_rows)).mapInArrow(_search(None, k, width), FOUND)
        best = best.join(lack.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(_best(rest, k))
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
