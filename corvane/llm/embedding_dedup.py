"""Operator 3. Embedding near-dedup by cross-polytope hashing after fast Hadamard rotations.

A hash is the nearest corner of the cross-polytope (the largest component and its sign) after three rounds
of random signs and Hadamard transforms; a bucket joins ``hashes`` of them.  In each of ``tables`` tables a
vector is posted in its own bucket and, for each hash, in the one with the second nearest corner instead
(multiprobe).  Pairs that share a bucket and the label are compared by exact cosine in double precision.
A pair counts in its smallest common bucket only.

Vectors of one label with the same components are one class, known by a number of its own; ids are brought back
at the end, so rows that share an id go by their own vectors.  Only (bucket, class) numbers move until a bucket
is known to hold two classes; large buckets are cut into blocks and every pair of blocks is one piece of work,
which returns link counts and a spanning forest per class, never pairs.

The setting is the same at every size.  Four hashes make 2^28 buckets of 64 components for each label and table,
so buckets stay nearly empty of strangers.  Measured on 20,000 made pairs at a cosine of exactly 0.98, a pair is missed
with probability 3e-4 at 64 components and 2e-3 at 256; closer pairs are missed less often, and more tables lower it.

Labels may be of any type that can be hashed; they are equal as Spark compares them (NaN equals NaN, 0.0 equals -0.0).

Defined cases: null labels and vectors that are null, empty, zero or hold null or non-finite components
link with nothing; vectors of different length never link; each row is a vector of its own, also where rows repeat an id
or are equal in all columns; component_id is the smallest id among the rows reached, so rows of one id may be in several
components.  A null id never names a component that holds an id; kept is then false, and true where no row has one.
Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, FractionalType

from corvane.llm._common import cut, group_starts, list_rows, local_forest, whole_groups
from corvane.llm.components import components
from corvane.llm.vectors import matrix, usable
from corvane.llm.wordhash import mix64

#: Classes in a block of one bucket.
BLOCK = 768


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row, scaled to keep lengths."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        z = np.empty_like(y)
        np.add(y[:, :, 0], y[:, :, 1], out=z[:, :, 0])
        np.subtract(y[:, :, 0], y[:, :, 1], out=z[:, :, 1])
        x, h = z.reshape(n, d), 2 * h
    return x / x.dtype.type(np.sqrt(d))


def _corners(x: np.ndarray, signs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest and second nearest corner of each row after the rotation by ``signs`` (three rounds)."""
    for s in signs:
        x = hadamard(x * s)
    size = np.abs(x)
    rows = np.arange(len(x))
    one = size.argmax(1)
    size[rows, one] = -1
    two = size.argmax(1)
    d = x.shape[1]
    return one + d * (x[rows, one] < 0), two + d * (x[rows, two] < 0)


def bucket_keys(x: np.ndarray, label: np.ndarray, tables: int, hashes: int, seed: int) -> np.ndarray:
    """Bucket keys (rows, tables, 1 + hashes): own bucket and probes, of vectors scaled to length 1; ``label`` is a number of the label."""
    d = 1 << max(0, int(x.shape[1] - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, d - x.shape[1]))).astype(np.float32)
    rng = np.random.default_rng(seed)
    out = np.empty((len(x), tables, hashes + 1), dtype=np.uint64)
    for t in range(tables):
        found = [_corners(x, rng.choice([-1.0, 1.0], (3, d)).astype(np.float32)) for _ in range(hashes)]
        for probe in range(hashes + 1):
            key = mix64(mix64(label.astype(np.int64).view(np.uint64)) ^ np.uint64((x.shape[1] << 20) + t + 1))
            for k, (one, two) in enumerate(found):
                key = mix64(key ^ ((two if probe == k + 1 else one).astype(np.uint64) + np.uint64((k + 1) << 32)))
            out[:, t, probe] = key
    return out.view(np.int64)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, by their largest component first, so that no square over- or underflows."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _with_keys(tables: int, hashes: int, seed: int):
    """Adds each class's bucket keys as the last column."""

    def run(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            vec, label = batch.column("embedding"), batch.column("l1").to_numpy()
            sizes = np.diff(vec.offsets.to_numpy())
            keys = np.empty((batch.num_rows, tables * (hashes + 1)), dtype=np.int64)
            for width in np.unique(sizes):
                at = np.flatnonzero(sizes == width)
                x = _unit(matrix(vec.take(pa.array(at)), int(width)))
                keys[at] = bucket_keys(x, label[at], tables, hashes, seed).reshape(len(at), -1)
            yield pa.RecordBatch.from_arrays([*batch.columns, list_rows(keys.ravel(), np.full(len(keys), keys.shape[1]), pa.int64())], [*batch.schema.names, "keys"])

    return run


def _compare(least: float):
    group = ["key", "l2", "width", "blk_p", "blk_q"]

    def run(batches):
        for tab in whole_groups(batches, group):
            bounds = group_starts(tab, group)
            rep, own, times, key = (tab.column(c).to_numpy() for c in ("class", "own", "times", "key"))
            vec, keys = tab.column("embedding").combine_chunks(), tab.column("keys").combine_chunks()
            out = []
            for s, e in zip(bounds[:-1], bounds[1:], strict=True):
                n = e - s
                if n < 2:
                    continue
                flat = vec.slice(s, n).flatten().to_numpy().astype(np.float64)
                x = _unit(flat.reshape(n, -1))
                hit = np.triu(x @ x.T >= least, 1)
                if not hit.any():
                    continue
                mine = own[s:e]
                if tab.column("blk_p")[s].as_py() != tab.column("blk_q")[s].as_py():
                    hit &= mine[:, None] != mine[None, :]
                i, j = np.nonzero(hit)
                # only in the smallest common bucket; each table's keys meet those of the same table
                k = keys.slice(s, n).flatten().to_numpy().reshape(n, -1)
                a, b, cur = k[i], k[j], key[s]
                early = np.zeros(len(i), dtype=bool)
                for c in range(k.shape[1]):
                    low = np.flatnonzero((a[:, c] < cur) & ~early)
                    early[low] = (b[low] == a[low, c, None]).any(1)
                i, j = i[~early], j[~early]
                if len(i) == 0:
                    continue
                w = times[s:e]
                links = np.bincount(i, w[j], n) + np.bincount(j, w[i], n)
                root = local_forest(n, i, j)
                some = np.flatnonzero(links)
                out.append((rep[s + some], links[some].astype(np.int64), rep[s + root[some]]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["class", "links", "root"])

    return run


def near_duplicates(
    vectors: DataFrame, least: float = 0.98, tables: int = 5, hashes: int = 4, seed: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """One row per input row: ``vec_id, n_links, component_id, kept``."""
    single = isinstance(vectors.schema[vec_col].dataType, ArrayType) and isinstance(vectors.schema[vec_col].dataType.elementType, FloatType)
    kind = "array<float>" if single else "array<double>"  # floats are exact as doubles and half the bytes to move
    label = F.col(label_col)
    if isinstance(vectors.schema[label_col].dataType, FractionalType):
        label = F.when(label == 0, F.lit(0).cast(vectors.schema[label_col].dataType)).otherwise(label)  # 0.0 and -0.0 are equal
    source = vectors.select(F.col(id_col).cast("long").alias("vec_id"), label.alias("label"), F.col(vec_col).cast(kind).alias("embedding"))
    # labels meet as two hashes of their value, whatever their type: one is part of the bucket key, the other is compared beside it
    source = source.withColumn("l1", F.xxhash64(F.lit(1), "label")).withColumn("l2", F.xxhash64(F.lit(2), "label"))
    fine = usable(F.col("embedding")) & F.col("label").isNotNull()
    source = source.withColumn("h1", F.when(fine, F.xxhash64(F.lit(1), "embedding"))).withColumn("h2", F.when(fine, F.xxhash64(F.lit(2), "embedding")))
    content = ["l1", "l2", "h1", "h2"]
    classes = source.filter("h1 is not null").groupBy(*content).agg(F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("times"), F.first("embedding").alias("embedding"))
    classes = classes.select(F.monotonically_increasing_id().alias("class"), *content, "low", "times", "embedding")
    # written once with their keys: the numbers given here stand from now on
    classes = cut(classes.mapInArrow(_with_keys(tables, hashes, seed), f"class long, l1 long, l2 long, h1 long, h2 long, low long, times long, embedding {kind}, keys array<long>"))
    flat = classes.select("class", F.explode("keys").alias("key"))
    sizes = flat.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = flat.join(cut(sizes), "key")
    blocks = F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")
    shared = shared.withColumn("own", F.pmod(F.xxhash64("class"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    shared = cut(shared.select("key", F.least("own", "other").alias("blk_p"), F.greatest("own", "other").alias("blk_q"), "own", "class"))
    group = ["key", "l2", "width", "blk_p", "blk_q"]
    rows = shared.join(classes.select("class", "l2", F.size("embedding").alias("width"), "times", "embedding", "keys"), "class")
    rows = rows.select(*group, "own", "class", "times", "embedding", "keys").repartition(*group).sortWithinPartitions(*group)
    found = cut(rows.mapInArrow(_compare(least), "class long, links long, root long"))
    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    roots = components(found, "class", "root").withColumnRenamed("node", "class")
    named = classes.select(*content, "class", "low", "times").join(links, "class", "left").join(roots, "class", "left").withColumn("root", F.coalesce("root", "class"))
    names = named.groupBy("root").agg(F.min("low").alias("component_id"))
    named = named.join(names, "root").select(*content, (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n"), F.lit(True).alias("in_class"), "component_id")
    out = source.select("vec_id", *content).join(named, content, "left")
    component = F.when(F.col("in_class"), F.col("component_id")).otherwise(F.col("vec_id"))
    out = out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
