"""What operators on vectors share: whole-number vectors in Arrow batches, exact distances."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A component becomes floor(SCALE * component).
SCALE = 256


def bound(dim: int) -> int:
    """Largest size of a whole component for which squared distances, also of doubled vectors, stay within a long."""
    return math.isqrt((1 << 62) // dim) // 4


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column without nulls, all of ``dim`` components."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column of the rows of a matrix."""
    n, dim = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * dim), pa.array(np.ascontiguousarray(rows).ravel(), kind))


def whole_vectors(df: DataFrame, vector: str, dim: int, keep: list[str], out: str = "v") -> DataFrame:
    """Columns ``keep`` and ``out``, an array of whole numbers floor(SCALE * component).

    Rows go whose vector is null, has another number of components than ``dim``,
    or holds a null or non-finite one. Components count as doubles; those beyond
    ``bound(dim)`` count as that bound.
    """
    most = bound(dim)

    def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.compute.equal(b.column(len(keep)).value_lengths(), dim))
            x = matrix(b.column(len(keep)), dim)
            fine = np.isfinite(x).all(axis=1)
            v = np.clip(np.floor(x[fine] * SCALE), -most, most).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.filter(pa.array(fine)).columns[:-1], lists(v, pa.int32())], [*keep, out])

    import pyarrow.compute  # noqa: F401  the name pa.compute

    told = df.select(*keep, F.col(vector).cast("array<double>").alias(out))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in told.select(*keep).schema)
    return told.mapInArrow(scaled, f"{schema}, {out} array<int>")


def squared(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Exact squared distances of whole vectors, a row per point: in floating
    point where all sums are below 2^53, else in whole numbers."""
    most = max((int(np.abs(m).max()) for m in (points, centres) if m.size), default=0)
    kind = np.float64 if 4 * most * most * points.shape[1] < 1 << 53 else np.int64
    p, c = points.astype(kind), centres.astype(kind)
    return ((p * p).sum(1)[:, None] - 2 * (p @ c.T) + (c * c).sum(1)).astype(np.int64)


