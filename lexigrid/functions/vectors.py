"""Vector expressions over ``array<float>``, summed in double precision and in order."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    """Length of a vector; 1 for the zero vector, so that dividing by it is safe."""
    n = F.sqrt(dot(a, a))
    return F.when(n == 0, F.lit(1.0)).otherwise(n)


def cosine(a: Column, b: Column, mode: str = "cosine") -> Column:
    """Cosine similarity; mode ``unit`` maps it to [0, 1] as ``(1 + cosine) / 2``."""
    c = dot(a, b) / (norm(a) * norm(b))
    return (1 + c) / 2 if mode == "unit" else c


def literal(vector: list[float]) -> Column:
    return F.array(*[F.lit(float(x)).cast("float") for x in vector])


def matrix(column: pa.Array, kind: type = np.float64) -> np.ndarray:
    """Rows of a list column, all of one length and none of them null, taken from Arrow's buffer at once."""
    lengths = pc.unique(pc.list_value_length(column)).to_pylist()
    if len(lengths) > 1:
        raise ValueError(f"vectors of several lengths: {sorted(lengths, key=str)[:5]}")
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), lengths[0] if lengths else 0)


def lengths(x: np.ndarray) -> np.ndarray:
    """Length of each row; 1 for a zero vector, as in ``norm``."""
    n = np.sqrt(np.cumsum(x * x, axis=1)[:, -1]) if x.size else np.zeros(len(x))
    return np.where(n == 0, 1.0, n)


def sql_dot(a: str, b: str) -> str:
    return f"list_reduce(list_transform(range(1, len({a}) + 1), lambda i: CAST({a}[i] AS DOUBLE) * CAST({b}[i] AS DOUBLE)), lambda s, x: s + x)"


def sql_cosine(a: str, b: str) -> str:
    return f"({sql_dot(a, b)} / (sqrt({sql_dot(a, a)}) * sqrt({sql_dot(b, b)})))"
