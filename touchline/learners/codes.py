"""Features as bytes: 255 cut points per feature, found once over all rows.

A value's code is the number of cut points below it, so ``x <= cut[c]`` and
``code <= c`` are the same test and trees split on codes.  The upper five bits
of a code are a coarser code of 32 values with every eighth cut point.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CUTS = 255


def cut_points(rows: DataFrame, features: list[str], accuracy: int = 10_000) -> np.ndarray:
    """``features x 255`` cut points: quantiles of all rows by one aggregate
    (nulls count as 0).  No rows: all cut points are 0."""
    at = F.array(*[F.lit((i + 1) / (CUTS + 1)) for i in range(CUTS)])  # built once: a call into the JVM per number
    got = rows.agg(*[F.percentile_approx(F.coalesce(F.col(f).cast("double"), F.lit(0.0)), at, accuracy).alias(f"q{i}")
                     for i, f in enumerate(features)]).first()  # one row
    return np.array([q if q is not None else [0.0] * CUTS for q in got], np.float64).reshape(len(features), CUTS)


def encode(x: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Codes of a matrix of values (rows x features)."""
    out = np.empty(x.shape, np.uint8)
    for j in range(x.shape[1]):
        out[:, j] = np.searchsorted(cuts[j], x[:, j], side="left")
    return out


def with_codes(rows: DataFrame, features: list[str], cuts: np.ndarray, keep: list[str]) -> DataFrame:
    """``keep`` and ``codes`` (binary, a byte per feature) of each row."""
    src = rows.select(*keep, *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f"x{i}") for i, f in enumerate(features)])
    first = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.stack([b.column(first + j).to_numpy(zero_copy_only=False) for j in range(len(features))], axis=1) \
                if b.num_rows else np.zeros((0, len(features)))
            yield pa.RecordBatch.from_arrays([*b.columns[:first], packed(encode(x, cuts))], names=[*keep, "codes"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return src.mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keep) + ", codes binary")


def packed(codes: np.ndarray) -> pa.Array:
    """A matrix of codes as one binary value per row."""
    offs = np.arange(len(codes) + 1, dtype=np.int32) * codes.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(codes), [None, pa.py_buffer(offs), pa.py_buffer(np.ascontiguousarray(codes))])


def unpacked(col: pa.Array, width: int) -> np.ndarray:
    """The matrix behind :func:`packed`."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if len(col) == 0:
        return np.zeros((0, width), np.uint8)
    _, offs, data = col.buffers()
    lo = int(np.frombuffer(offs, np.int32)[col.offset])
    return np.frombuffer(data, np.uint8)[lo:lo + len(col) * width].reshape(len(col), width)
