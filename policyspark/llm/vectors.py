"""Embeddings as exact integers, for the operators that need results that don't depend on the order of sums."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Integer components stay below this, so that sums of squares of a thousand differences fit a long.
LARGEST = 1 << 26


def integer_vectors(rows: DataFrame, scale: int, keep: list[str], vector: str = "embedding") -> tuple[DataFrame, int]:
    """``rows`` with ``x``, the integers floor(scale * component), and the number of components.

    Rows whose vector is null or empty, or holds null, NaN or infinity, go. So
    do vectors of another length than most have (of equally many the longer
    one), since they aren't of the same space. Of other columns those in
    ``keep`` stay. An empty table gives an empty one and no components. Components of
    ``LARGEST`` or more raise a ValueError.
    """
    finite = F.forall(F.col(vector), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    whole: Column = F.transform(F.col(vector), lambda c: F.floor(c.cast("double") * scale))
    x = rows.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & finite).select(*keep, whole.alias("x"))
    by_size = x.groupBy(F.size("x").alias("size")).agg(F.count("*").alias("n"), F.max(F.array_max(F.transform("x", F.abs))).alias("most"))
    found = by_size.orderBy(F.desc("n"), F.desc("size")).limit(1).collect()
    if not found:
        return x, 0
    if found[0]["most"] >= LARGEST:
        raise ValueError(f"a component times {scale} is {LARGEST} or more")
    return x.where(F.size("x") == found[0]["size"]), found[0]["size"]


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A column of lists of ``width`` integers as rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    """The rows of a matrix as a column of lists."""
    n, width = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(rows.ravel(), kind))
