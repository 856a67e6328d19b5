"""Intermediate tables in the folder that all executors share, so that a lost executor costs a re-read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a local session without one gets its own, a cluster an error."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is unset: name a folder there that all executors share")
        place = tempfile.mkdtemp(prefix="corvane-")
        spark.conf.set("spark.checkpoint.dir", place)
    return f"{place.rstrip('/')}/corvane/{spark.sparkContext.applicationId}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written there and read back."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
