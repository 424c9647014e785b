"""Whitening, covariance, clusters and geometry of sets of vectors."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postwright.functions.hashing import md5_int
from postwright.functions.vectors import DOUBLES, l2_normalise


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, total, outer = 0, None, None
    for b in batches:
        if b.num_rows:
            x = b.column(0).flatten().to_numpy().reshape(b.num_rows, -1)
            n += len(x)
            total = x.sum(axis=0) if total is None else total + x.sum(axis=0)
            outer = x.T @ x if outer is None else outer + x.T @ x
    if n:
        d = len(total)
        i, j = np.divmod(np.arange(d * d), d)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([np.full(d, -1), i]).astype(np.int32)), pa.array(np.concatenate([np.arange(d), j]).astype(np.int32)), pa.array(np.concatenate([total, outer.ravel()])), pa.array(np.full(d + d * d, n, np.int64))],
            names=["i", "j", "v", "n"],
        )


def moments(vectors: DataFrame, vec: str = "vec") -> DataFrame:
    """(i, j, v, n): sums of products of dimensions (i = -1: sums) and counts. A task sends d² numbers, however many vectors it has."""
    return vectors.select(F.col(vec).cast(DOUBLES).alias("x")).mapInArrow(_moments, "i int, j int, v double, n long").groupBy("i", "j").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))


def mean_covariance(vectors: DataFrame, vec: str = "vec") -> DataFrame:
    """(i, j, v): the mean (i = -1) and the sample covariance."""
    m = moments(vectors, vec)
    means = m.where("i = -1").select(F.col("j").alias("d"), (F.col("v") / F.col("n")).alias("mu"))
    a, b = means.select(F.col("d").alias("i"), F.col("mu").alias("mi")), means.select(F.col("d").alias("j"), F.col("mu").alias("mj"))
    cov = m.where("i >= 0").join(F.broadcast(a), "i").join(F.broadcast(b), "j").select("i", "j", ((F.col("v") - F.col("n") * F.col("mi") * F.col("mj")) / (F.col("n") - 1)).alias("v"))
    return means.select(F.lit(-1).alias("i"), F.col("d").alias("j"), F.col("mu").alias("v")).union(cov)


def whitening(stats: DataFrame, shrink: float = 0.01) -> tuple[np.ndarray, np.ndarray]:
    """(mean, matrix): the inverse square root of the covariance shrunk towards its mean variance (A15). A d x d matrix on the driver."""
    rows = stats.toPandas()
    mu = rows[rows.i < 0].sort_values("j").v.to_numpy()
    cov = rows[rows.i >= 0].sort_values(["i", "j"]).v.to_numpy().reshape(len(mu), -1)
    cov = cov + shrink * np.trace(cov) / len(mu) * np.eye(len(mu))
    values, vectors = np.linalg.eigh(cov)
    return mu, vectors @ np.diag(values**-0.5) @ vectors.T


def transform(vectors: DataFrame, mu: np.ndarray, matrix: np.ndarray | None = None, normalise: bool = True, vec: str = "vec") -> DataFrame:
    """Vectors centred, whitened where a matrix is given, and normalised."""
    shared = vectors.sparkSession.sparkContext.broadcast((mu, matrix))
    at = vectors.columns.index(vec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, w = shared.value
        for b in batches:
            if b.num_rows:
                x = b.column(at).flatten().to_numpy().reshape(b.num_rows, -1) - m
                x = x @ w if w is not None else x
                if normalise:
                    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
                col = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([col if k == at else c for k, c in enumerate(b.columns)], names=b.schema.names)

    typed = vectors.withColumn(vec, F.col(vec).cast(DOUBLES))
    return typed.mapInArrow(run, typed.schema)


def shift(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: mean and covariance of ``a`` compared with ``b``'s, each difference relative, and whether both stay under 0.05."""
    j = a.select("i", "j", F.col("v").alias("x")).join(b.select("i", "j", F.col("v").alias("y")), ["i", "j"])
    d, mean = F.col("x") - F.col("y"), F.col("i") < 0
    rel = lambda c: F.sqrt(F.sum(F.when(c, d * d))) / F.sqrt(F.sum(F.when(c, F.col("y") * F.col("y"))))
    out = j.agg(rel(mean).alias("mean_shift"), rel(~mean).alias("cov_shift"))
    return out.withColumn("shared_ok", (F.col("mean_shift") < 0.05) & (F.col("cov_shift") < 0.05))


def mean_pairwise_cosine(vectors: DataFrame, by: list[str], vec: str = "vec") -> DataFrame:
    """(by, n, cosine): the mean over pairs from the sum's norm, no pair is formed (A40). Vectors have unit norm."""
    d = vectors.select(*by, F.posexplode(F.col(vec).cast(DOUBLES)).alias("i", "x")).groupBy(*by, "i").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.count("*").alias("n"))
    g = d.groupBy(*by).agg(F.max("n").alias("n"), F.sum(F.col("s") * F.col("s")).alias("s2"), F.sum("q").alias("q"))
    return g.where("n > 1").select(*by, "n", ((F.col("s2") - F.col("q")) / (F.col("n").cast("double") * (F.col("n") - 1))).alias("cosine"))


def eigen_shares(stats: DataFrame) -> tuple[float, float]:
    """Shares of the largest and the five largest eigenvalues of a covariance."""
    rows = stats.where("i >= 0").toPandas().sort_values(["i", "j"])
    d = int(rows.i.max()) + 1
    values = np.linalg.eigvalsh(rows.v.to_numpy().reshape(d, d))[::-1]
    return float(values[0] / values.sum()), float(values[:5].sum() / values.sum())


def head(vectors: DataFrame, w1: np.ndarray, w2: np.ndarray, vec: str = "vec", activation: str = "gelu") -> DataFrame:
    """Residual head h + W2 f(W1 h), normalised (F8, F9), f the exact gelu or relu; zero W2 is the identity on unit vectors."""
    if activation not in ("gelu", "relu"):
        raise ValueError(f"unknown activation {activation}")
    erf = np.vectorize(math.erf)
    at = vectors.columns.index(vec)
    typed = vectors.withColumn(vec, F.col(vec).cast(DOUBLES))

    def run(batches):
        for b in batches:
            if b.num_rows:
                h = b.column(at).flatten().to_numpy().reshape(b.num_rows, -1)
                z = h @ w1.T
                z = np.maximum(z, 0.0) if activation == "relu" else z * 0.5 * (1 + erf(z / math.sqrt(2)))
                h = h + z @ w2.T
                h = h / np.maximum(np.linalg.norm(h, axis=1, keepdims=True), 1e-12)
                col = pa.ListArray.from_arrays(pa.array(np.arange(0, h.size + 1, h.shape[1]), pa.int32()), pa.array(h.ravel()))
                yield pa.RecordBatch.from_arrays([col if k == at else c for k, c in enumerate(b.columns)], names=b.schema.names)

    return typed.mapInArrow(run, typed.schema)


def logits(sims: DataFrame, scale: float, bias: float) -> DataFrame:
    """Similarities as logits, scale * sim - bias (F8)."""
    return sims.withColumn("sim", F.col("sim") * scale - bias)


def random_unit_vectors(ids: DataFrame, dim: int, seed: int = 11, key: str = "entry_id") -> DataFrame:
    """(key, vec): directions of no meaning, one for each id, the same whatever the partitioning (O11, G8): normal numbers from pairs of hashes, normalised."""
    def uniform(i, which: str):
        return (md5_int(F.concat_ws("|", F.lit(f"normal/{seed}/{which}"), F.col(key).cast("string"), i.cast("string"))) + 0.5) / float(1 << 32)

    normal = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.sqrt(-2 * F.log(uniform(i, "r"))) * F.cos(2 * math.pi * uniform(i, "a")))
    return ids.select(key, l2_normalise(normal).alias("vec"))
