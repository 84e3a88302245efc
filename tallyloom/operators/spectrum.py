"""Singular values of tall matrices whose rows are spread over the cluster, by their Gram matrix."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The Gram matrix is d x d on the driver; wider matrices are an error.
MOST_COLUMNS = 2048


def difference(a: DataFrame, b: DataFrame, key: str, vector: str) -> DataFrame:
    """Rows of b less those of a with the same key; rows that only one has, or whose widths differ, are left out."""
    other = a.select(F.col(key).alias("_key"), F.col(vector).alias("_other"))
    joined = b.select(key, vector).join(other, F.col(key) == F.col("_key")).where(F.size(vector) == F.size("_other"))
    return joined.select(key, F.zip_with(vector, "_other", lambda x, y: x.cast("double") - y.cast("double")).alias(vector))


def matrix_of(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def gram(rows: DataFrame, vector: str) -> DataFrame:
    """i, j and the sum over rows of x_i * x_j: products are summed up block by block within tasks, then over tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            m = matrix_of(batch.column(0))
            if len(m):
                if m.shape[1] > MOST_COLUMNS:
                    raise ValueError(f"{m.shape[1]} columns are more than {MOST_COLUMNS}")
                total = m.T @ m if total is None else total + m.T @ m
        if total is not None:
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())], names=["i", "j", "x"])

    parts = rows.where(F.col(vector).isNotNull()).select(vector).mapInArrow(run, "i int, j int, x double")
    return parts.groupBy("i", "j").agg(F.sum("x").alias("x"))


def eigenpairs(entries: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Singular values, largest first, and right singular vectors as columns; their signs make the largest entry positive."""
    got = entries.toPandas()
    d = int(got["i"].max()) + 1 if len(got) else 0
    g = np.zeros((d, d))
    g[got["i"], got["j"]] = got["x"]
    values, vectors = np.linalg.eigh((g + g.T) / 2)
    values, vectors = np.sqrt(np.maximum(values[::-1], 0.0)), vectors[:, ::-1]
    return values, vectors * np.where(np.take_along_axis(vectors, np.abs(vectors).argmax(0)[None], 0)[0] < 0, -1.0, 1.0) if d else vectors


def scree(sigma: np.ndarray, k: int) -> list[tuple[int, float, float, float, float]]:
    """(component, sigma, sigma over the Frobenius norm, share of variance, cumulative share) of the first k."""
    whole = float((sigma**2).sum())
    if whole == 0:
        return []
    share = sigma**2 / whole
    return [(i + 1, float(sigma[i]), float(sigma[i] / np.sqrt(whole)), float(share[i]), float(share[: i + 1].sum())) for i in range(min(k, len(sigma)))]


def cosines(rows: DataFrame, key: str, vector: str, sigma: np.ndarray, vectors: np.ndarray, components: int) -> DataFrame:
    """For each row and component, the entry of the left singular vector: its cosine with the row's axis."""
    own = [c for c in range(min(components, len(sigma))) if sigma[c] > 0]
    if not own:
        return rows.select(key, F.lit(0).alias("component"), F.lit(0.0).alias("cosine")).limit(0)
    dot = lambda c: F.aggregate(F.zip_with(vector, F.array(*[F.lit(float(v)) for v in vectors[:, c] / sigma[c]]), lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    return rows.where(F.col(vector).isNotNull()).select(key, F.posexplode(F.array(*[dot(c) for c in own])).alias("component", "cosine")).select(key, (F.col("component") + 1).alias("component"), "cosine")
