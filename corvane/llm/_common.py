"""What the operators of this subpackage share: reading, checkpoints, grouped batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than space and U+0009..U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir.

    Where it is unset, a local session gets a folder of its own; on a cluster that would be another one on each machine,
    so there it is an error.
    """
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is unset: name a folder there that all executors share")
        place = tempfile.mkdtemp(prefix="corvane-")
        spark.conf.set("spark.checkpoint.dir", place)
    return f"{place.rstrip('/')}/corvane/{spark.sparkContext.applicationId}"


#: The part of the shared folder that ``cut`` writes to just now; see ``scratch``.
_part = ContextVar("part", default="")


def cut(df: DataFrame, part: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later steps neither repeat its work nor depend on executors."""
    path = f"{shared_dir(df.sparkSession)}/{_part.get() if part is None else part}{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What ``cut`` writes within is deleted at the end; results that are still needed must be written elsewhere by then."""
    held = _part.set(f"scratch-{uuid.uuid4().hex}/")
    try:
        yield
    finally:
        folder = f"{shared_dir(spark)}/{_part.get()}"
        _part.reset(held)
        _delete(spark, folder)


def drop_cuts(spark: SparkSession) -> None:
    """Delete all that ``cut`` wrote for this application. Call it once results are stored: results still to be read need the files."""
    _delete(spark, shared_dir(spark))


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """True where crc32 of the id as text falls in ``fold``; such rows are never learnt from. Null ids count as not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def drawn(df: DataFrame, key: str, n: int, total: int) -> DataFrame:
    """``n`` of ``total`` rows: those with the smallest hash of ``key``, at every size.

    Of large tables only the lowest hashes, of about 2 * n rows, are put in order, so not every task hands on n rows.
    """
    low = F.pmod(F.xxhash64(key), F.lit(1 << 40))
    if total > 4 * n:
        df = df.filter(low < F.lit(-(-(2 * n << 40) // total)))
    return df.orderBy(low, key).limit(n)


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Batches sorted by ``keys`` as tables that end where a group ends, so that no group is torn."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        change = np.zeros(batch.num_rows, dtype=bool)
        for k in keys:
            v = batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False)
            change[1:] |= v[1:] != v[:-1]
            if held:
                last = held[-1]
                change[0] |= last.column(last.schema.get_field_index(k))[-1].as_py() != v[0]
        at = np.flatnonzero(change)
        if len(at) == 0:
            held.append(batch)
            continue
        end = int(at[-1])
        if held or end:
            yield pa.Table.from_batches([*held, batch.slice(0, end)])
        held = [batch.slice(end)]
    if held:
        yield pa.Table.from_batches(held)


def slices(batch: pa.RecordBatch, text: str, rows: int = 512, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most ``rows`` rows and about ``size`` bytes of text (one text at least), so that long texts do not add up."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0))
    ends = np.cumsum(lengths)
    at = 0
    while at < batch.num_rows:
        full = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right"))
        end = min(at + rows, max(at + 1, full), batch.num_rows)
        yield batch.slice(at, end - at)
        at = end


def group_starts(tab: pa.Table, keys: list[str]) -> np.ndarray:
    """Where each group of a sorted table starts, and its end."""
    change = np.zeros(tab.num_rows, dtype=bool)
    change[0] = True
    for k in keys:
        v = tab.column(k).to_numpy()
        change[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(change), tab.num_rows)


def binary_rows(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Each row's run of ``values`` as a binary cell."""
    width = values.dtype.itemsize
    offsets = np.concatenate([[0], np.cumsum(sizes)]) * width
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))]
    ).cast(pa.binary())


def list_rows(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values, kind))


def local_forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Label of each of ``n`` nodes: the smallest node it reaches over the edges (a, b)."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if np.array_equal(label, before):
            return label


def block_pairs(df: DataFrame, size: str, member: str, width: int) -> DataFrame:
    """Split hot groups: rows of a group of ``size`` rows are dealt by a hash of ``member`` over
    ceil(size / width) blocks, and each row goes to every pair of blocks (blk_p <= blk_q) with its own.
    A group of up to ``width`` rows stays one block. No pair of rows of a group is missed."""
    blocks = F.ceil(F.col(size) / F.lit(width)).cast("int")
    own = F.pmod(F.xxhash64(member), blocks).cast("int")
    return (
        df.withColumn("_own", own)
        .withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .withColumn("blk_p", F.least("_own", "_other"))
        .withColumn("blk_q", F.greatest("_own", "_other"))
        .drop("_own", "_other")
    )
