"""Whitening of embeddings: rows projected on the leading components of their covariance, at unit variance.

Three passes over the vectors, in tasks that add up their batches: sums of each dimension (exact integers), the
covariance of the centred rows (a task sends one matrix, its rows are added by Spark), and the projection. Between them
the driver holds sums and a covariance of dimension squared, whatever the number of rows, and finds the leading
eigenpairs (eigen.py); components and scales go to the tasks as one small broadcast. A fourth pass adds up the
covariance of the whitened rows, whose largest departure from the identity is in every row of the result.

Values are quantised: x = floor(scale * c) + shift, whole numbers; centring subtracts whole numbers first, so that
a shift costs no digits.

Defined cases: vectors that are null or hold null or non-finite components take no part; empty vectors have no
dimension and take no part, unless all are empty: then there are no rows; shorter vectors are filled up with
components of 0.0 to the length of the longest; repeated rows count, and come out, repeatedly; a null id is an id;
components whose eigenvalue is nothing but rounding (under 1e-12 of the largest) have no direction and are left out, so that
one vector, or copies of one, give no rows; an empty table gives no rows. Values whose exact deviation does not fit a long
stop the job with an OverflowError.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tastegrid.llm.common import batches, table, usable_vector, written
from tastegrid.llm.eigen import leading

COMPONENTS, NOISE, BATCH = 32, 1e-12, 4096


def whole_numbers(col: pa.Array, dim: int, scale: int, shift: int) -> np.ndarray:
    """The quantised matrix of a list column, in int64."""
    lengths = np.diff(col.offsets.to_numpy())
    out = np.zeros((len(lengths), dim))
    out[np.arange(dim)[None, :] < lengths[:, None]] = col.flatten().to_numpy(zero_copy_only=False)
    out = np.floor(out * scale)
    if len(out) and np.abs(out).max() >= 2**62:
        raise OverflowError("components too large for whole numbers of 64 bits")
    return out.astype(np.int64) + shift


def vectors(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    return df.filter(usable_vector(vector) & (F.size(vector) > 0)).select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))


def _quantised(rows: Iterator[pa.RecordBatch], dim: int, scale: int, shift: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for b in batches(rows):
        for at in range(0, b.num_rows, BATCH):
            part = b.slice(at, BATCH)
            yield part["id"], whole_numbers(pa.concat_arrays([part["v"]]), dim, scale, shift)


def sums(df: DataFrame, dim: int, scale: int, shift: int) -> tuple[int, list[int]]:
    """Number of rows and the sum of each dimension, exactly."""

    def task(rows):
        n, total = 0, [0] * dim
        for _, x in _quantised(rows, dim, scale, shift):
            n += len(x)
            total = [a + int(b) for a, b in zip(total, (x - shift).sum(axis=0), strict=True)]
        if n:
            yield pa.record_batch({"d": pa.array(range(dim), pa.int32()), "n": pa.array([n] * dim, pa.int64()), "s": pa.array([str(t + n * shift) for t in total])})

    parts = df.mapInArrow(task, "d int, n long, s string").groupBy("d").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    got = sorted(parts.collect())  # a row for each dimension
    return (got[0].n, [int(r.s) for r in got]) if got else (0, [])


def covariance(df: DataFrame, dim: int, rows_of, n: int) -> np.ndarray:
    """sum(y y') / n over the rows y that rows_of makes of a task's batches."""

    def task(rows):
        total = np.zeros((dim, dim))
        seen = 0
        for y in rows_of(rows):
            total += y.T @ y
            seen += len(y)
        if seen:
            i, j = np.triu_indices(dim)
            yield pa.record_batch({"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "v": total[i, j]})

    got = df.mapInArrow(task, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()  # dim * (dim + 1) / 2 rows
    out = np.zeros((dim, dim))
    i, j, v = (got[c].to_numpy() for c in ("i", "j", "v"))
    out[i, j] = out[j, i] = v / n
    return out


def whiten(df: DataFrame, components: int = COMPONENTS, scale: int = 64, shift: int = 1_000_000, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): each vector on each of the leading components."""
    spark = df.sparkSession
    schema = f"{id_col} long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    df = written(vectors(df, id_col, vector), "whiten-vectors")
    dim = df.agg(F.max(F.size("v"))).first()[0] or 0
    n, total = sums(df, dim, scale, shift)
    if not n:
        return spark.createDataFrame([], schema)
    base = np.array([t // n for t in total])  # whole numbers near the means
    rest = np.array([(t % n) / n for t in total])
    centred = lambda x: (x - base) - rest

    cov = covariance(df, dim, lambda rows: (centred(x) for _, x in _quantised(rows, dim, scale, shift)), n)
    values, axes = leading(cov, components)
    keep = values > NOISE * max(values.max(initial=0), 0)
    values, axes = values[keep], axes[:, keep]
    k = len(values)
    if not k:
        return spark.createDataFrame([], schema)
    explained = values / np.trace(cov)
    onto = spark.sparkContext.broadcast(axes / np.sqrt(values))  # dim by components

    own = covariance(df, k, lambda rows: (centred(x) @ onto.value for _, x in _quantised(rows, dim, scale, shift)), n)
    error = float(np.abs(own - np.eye(k)).max())
    left = np.array([t % n for t in total], dtype=np.int64)

    def task(rows):
        for ids, x in _quantised(rows, dim, scale, shift):
            off = x - base
            if len(x) and (np.square(off.astype(float) * n - left).sum(axis=1) >= 2**63).any():
                raise OverflowError("a deviation does not fit 64 bits")
            off = off * n - left  # n * x - S
            yield pa.record_batch({
                id_col: ids.take(pa.array(np.repeat(np.arange(len(x)), k))), "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), "n": pa.array(np.full(len(x) * k, n)),
                "deviation": np.repeat(np.square(off).sum(axis=1), k), "whitened": (centred(x) @ onto.value).ravel(), "explained": np.tile(explained, len(x)), "identity_error": np.full(len(x) * k, error),
            })

    return df.mapInArrow(task, schema)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
