"""What the vector operators share: rows with whole vectors, their components as whole numbers.

Rows whose vector is null, or holds a null, NaN or infinite component, are left out; so are vectors of another length than
that of the smallest vec_id, as null vectors are, for want of the same dimensions. Components become floor(``scale`` * x).
Scaled components of 2**24 and more in size are an error rather than a wrong number: below, squared distances and products
of up to 8,192 dimensions fit a long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE = 256
_MOST = 1 << 24


def whole_vectors(df: DataFrame, scale: int = SCALE, vector: str = "embedding") -> tuple[DataFrame, int]:
    """(vec_id, label, v array<int>) of the rows with a whole vector, and the number of dimensions (0: no such row)."""
    x = F.col("x")
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col(vector).cast("array<double>").alias("x"))
    rows = rows.filter(x.isNotNull() & (F.size("x") > 0) & finite)
    dims = rows.agg(F.min_by(F.size("x"), F.coalesce("vec_id", F.lit((1 << 63) - 1)))).first()[0] or 0

    def scaled(c):
        y = F.lit(float(scale)) * c
        return F.when(F.abs(y) < _MOST, F.floor(y)).otherwise(F.raise_error(F.lit("a component is too large"))).cast("int")

    return rows.filter(F.size("x") == dims).select("vec_id", "label", F.transform("x", scaled).alias("v")), dims


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """A list column of equally long lists without nulls as a matrix of whole numbers."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dims)


def lists(values: np.ndarray) -> pa.ListArray:
    """The rows of a matrix as a list column."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), pa.array(np.ascontiguousarray(values).reshape(-1)))
