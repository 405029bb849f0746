"""What the operators on vectors share: which rows take part, and their vectors as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(vectors: DataFrame, vec_id: str, vector: str, zero: bool = True) -> tuple[DataFrame, int]:
    """(vec_id, x array<double>) of the rows that take part, and the length of x (0 where no row does).

    A vector takes part if it is neither null nor empty and holds neither null, NaN nor infinity; zero=False leaves out zero vectors too.
    Where lengths differ, the commonest takes part, the longest of those that tie. Other columns don't go on.
    """
    x = F.col(vector).cast("array<double>")
    good = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.select(F.col(vec_id).alias("vec_id"), x.alias("x")).where(F.col("x").isNotNull() & (F.size("x") > 0) & good)
    if not zero:
        rows = rows.where(F.exists("x", lambda c: c != 0))
    first = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    width = first[0]["d"] if first else 0
    return rows.where(F.size("x") == width), width


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A column of lists of one length, without nulls, as a matrix of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(column), width)
