"""Streaming sinks: batches that update a stored table by key, and batches that are handed on.

The table lies in ``buckets`` partitions by a hash of its key.  A batch reads and rewrites the partitions that its keys fall into and no
others.  The newest row of a key wins by ``order``, so a batch that is replayed, or that comes after a newer one, changes nothing; a
batch whose number is marked as done is not even read again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from corvane.operators.rows import latest
from corvane.sources.shared import stored


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table as it stands; empty where nothing was written yet."""
    found = f"{path}/rows"
    return spark.read.schema(f"{schema}, bucket int").parquet(found).drop("bucket") if _exists(spark, found) else spark.createDataFrame([], schema)


def apply_batch(batch: DataFrame, path: str, keys: Sequence[str], order: Sequence[str], buckets: int = 64) -> list[int]:
    """Bring a batch into the table; the numbers of the partitions that were rewritten.

    Null keys are keys like others; of rows with one key the greatest by ``order``, then by all columns, stays; columns are the batch's own.
    """
    spark, schema = batch.sparkSession, batch.schema
    bucket = F.pmod(F.hash(*keys), F.lit(buckets)).cast("int").alias("bucket")
    new = stored(batch.select("*", bucket))
    touched = sorted(r["bucket"] for r in new.select("bucket").distinct().collect())  # at most ``buckets`` numbers
    if not touched:
        return []
    rows = new
    if _exists(spark, f"{path}/rows"):
        old = spark.read.schema(new.schema).parquet(f"{path}/rows").filter(F.col("bucket").isin(touched))
        rows = old.unionByName(new)
    best = latest(rows, keys, *[F.col(c).desc_nulls_last() for c in [*order, *schema.names]])
    # written apart first: the old partitions are still read while the new ones are made
    best = stored(best)
    best.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{path}/rows")
    return touched


def upsert_stream(
    stream: DataFrame, path: str, keys: Sequence[str], order: Sequence[str], checkpoint: str, buckets: int = 64, push: Callable[[Iterable[Row]], None] | None = None
):
    """A started query that brings every batch into the table; ``push`` gets each batch's rows by partition, at least once."""

    def take(batch: DataFrame, number: int) -> None:
        spark, mark = batch.sparkSession, f"{path}/done/{number}"
        if _exists(spark, mark):
            return
        rows = stored(batch) if push else batch
        apply_batch(rows, path, keys, order, buckets)
        if push:
            rows.foreachPartition(push)
        spark.range(1).select(F.lit(number).alias("batch")).coalesce(1).write.mode("overwrite").parquet(mark)

    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
