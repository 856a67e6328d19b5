"""Vectors: which take part, and conversion of Arrow lists to numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(v: Column) -> Column:
    """True for a vector that is not null, empty or zero and holds no null or non-finite component."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def most_common_width(df: DataFrame, v: str) -> int:
    """The number of components that most vectors have (the smaller in a tie); 0 without vectors."""
    row = df.groupBy(F.size(v).alias("w")).count().orderBy(F.desc("count"), "w").first()
    return int(row["w"]) if row else 0


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of equal width as a matrix of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
