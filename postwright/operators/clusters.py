"""Spherical k-means over many vectors, and many small ones at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postwright.functions.hashing import sample_key
from postwright.functions.vectors import DOUBLES, l2_normalise

#: Decimals of similarities that assignments are made by.
DIGITS = 8
#: Numbers that the centres of all starts may be, at most.
CENTRE_CELLS = 8 << 20
#: Cells of a slice of the batched small problems.
SLICE_CELLS = 4 << 20


def _drawn(vectors: DataFrame, key: str, seed: str, k: int) -> list[np.ndarray]:
    """The ``k`` vectors with the smallest hashes: a uniform draw that no partitioning changes."""
    return [np.array(r.vec) for r in vectors.withColumn("h", sample_key(seed, key)).orderBy("h", key).limit(k).select("vec").collect()]


def _assigned(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sim = np.round(x @ centres.T, DIGITS)
    own = sim.argmax(axis=1)
    return own, sim[np.arange(len(x)), own]


def _sums(sent, dim: int):
    """(key, vec) to (start, cluster, n, total similarity, sum of vectors) of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = sent.value
        starts, k, _ = centres.shape
        n, total, sums = np.zeros((starts, k), np.int64), np.zeros((starts, k)), np.zeros((starts, k, dim))
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(1).flatten().to_numpy().reshape(b.num_rows, -1)
            for s in range(starts):
                own, sim = _assigned(x, centres[s])
                order = np.argsort(own, kind="stable")
                first = np.flatnonzero(np.diff(own[order], prepend=-1))
                there = own[order][first]
                n[s] += np.bincount(own, minlength=k)
                total[s] += np.bincount(own, sim, minlength=k)
                sums[s, there] += np.add.reduceat(x[order], first, axis=0)
        s, c = np.nonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(s.astype(np.int32)), pa.array(c.astype(np.int32)), pa.array(n[s, c]), pa.array(total[s, c]), pa.array(list(sums[s, c]), pa.list_(pa.float64()))],
            names=["start", "cluster", "n", "total", "vec"],
        )

    return run


def spherical_kmeans(vectors: DataFrame, k: int, key: str = "entry_id", seed: int = 7, rounds: int = 30, starts: int = 1) -> DataFrame:
    """(key, cluster) of ``vectors`` (key, vec), each key once: k-means by cosine, ``rounds`` rounds from rows drawn by hash, the best of several ``starts``.

    Vectors are normalised; ties go to the lower cluster and the earlier start. A centre that no row is closest to is put on a row drawn anew. All starts
    take one pass a round, in which a task sends one sum a centre. Zero vectors are like no centre and go to the first. With fewer rows than ``k`` there are as many clusters as rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(key, l2_normalise(F.col("vec").cast(DOUBLES)).alias("vec"))
    first = _drawn(rows, key, f"kmeans/{seed}/0", k)
    if not first:
        return rows.select(key, F.lit(0).alias("cluster"))
    k, dim = len(first), len(first[0])
    if starts * k * dim > CENTRE_CELLS:
        raise ValueError(f"{starts * k * dim} numbers of centres, more than the {CENTRE_CELLS} that are sent at once")
    centres = np.array([first, *(_drawn(rows, key, f"kmeans/{seed}/{s}", k) for s in range(1, starts))])
    quality = np.zeros(starts)
    for i in range(rounds):
        sent = spark.sparkContext.broadcast(centres)
        parts = rows.mapInArrow(_sums(sent, dim), "start int, cluster int, n long, total double, vec array<double>")
        each = parts.select("start", "cluster", "n", "total", F.posexplode("vec").alias("i", "x")).groupBy("start", "cluster", "i").agg(*[F.sum(c).alias(c) for c in ("n", "total", "x")])
        t = each.groupBy("start", "cluster").agg(F.max("total").alias("total"), F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("vec")).toArrow()
        s, c = t.column("start").to_numpy(), t.column("cluster").to_numpy()
        quality = np.bincount(s, t.column("total").to_numpy(), minlength=starts)  # of the centres that this round began with
        new = np.full_like(centres, np.nan)
        sums = np.array(t.column("vec").to_pylist())
        new[s, c] = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
        for a, e in zip(*np.nonzero(np.isnan(new[:, :, 0])), strict=True):
            new[a, e] = _drawn(rows, key, f"reseed/{seed}/{a}/{i}/{e}", 1)[0]
        sent.unpersist()
        if i + 1 < rounds:
            if np.array_equal(new, centres):
                break
            centres = new
    # As in the last round: rows go to the centres that it began with.
    best = spark.sparkContext.broadcast(centres[int(np.argmax(np.round(quality, 6)))])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                own, _ = _assigned(b.column(1).flatten().to_numpy().reshape(b.num_rows, -1), best.value)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own.astype(np.int32))], names=[key, "cluster"])

    return rows.mapInArrow(assign, f"{key} {rows.schema[key].dataType.simpleString()}, cluster int")


def atoms(vectors: DataFrame, m: int, most: int = 100, key: str = "entry_id", rounds: int = 20) -> DataFrame:
    """(key, atom, vec): ``m`` means of each entry's sampled states, by k-means of its own (the multi-prototype entries of M9).

    ``vectors``: key, slot, vec, each slot once; an entry has ``most`` slots at most (see the occurrence sample), so its states are one row. Starts are the first ``m`` slots, which are a uniform draw;
    distances are Euclidean, ties go to the lower atom, an atom without states goes back to the first slot. Entries of a batch are worked on at once, padded to the
    longest; one of fewer than ``m`` states has as many atoms as states.
    """
    kind = vectors.schema[key].dataType.simpleString()
    rows = vectors.where(F.col("slot") < most).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("slot", F.col("vec").cast(DOUBLES).alias("vec")))).alias("s"))
    rows = rows.select(key, F.size("s").alias("n"), F.flatten("s.vec").alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            n = b.column(1).to_numpy()
            flat = b.column(2).flatten().to_numpy()
            dim = len(flat) // n.sum()
            ends = np.cumsum(n)
            step = max(1, SLICE_CELLS // (int(n.max()) * (dim + m)))
            for at in range(0, len(n), step):
                own = n[at : at + step]
                x, there = np.zeros((len(own), own.max(), dim)), np.arange(own.max()) < own[:, None]
                x[there] = flat[(ends[at] - n[at]) * dim : ends[at + len(own) - 1] * dim].reshape(-1, dim)
                c = small_kmeans(x, there, m, rounds)
                real = np.arange(c.shape[1]) < np.minimum(own, m)[:, None]
                i, a = np.nonzero(real)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, step).take(pa.array(i)), pa.array(a.astype(np.int32)), pa.array(list(c[real]), pa.list_(pa.float64()))], names=[key, "atom", "vec"])

    return rows.mapInArrow(run, f"{key} {kind}, atom int, vec array<double>")


def small_kmeans(x: np.ndarray, there: np.ndarray, m: int, rounds: int) -> np.ndarray:
    """Means (problems x atoms x dim) of problems x rows x dim, of which ``there`` says which rows are real."""
    m = min(m, x.shape[1])
    c = x[:, :m].copy()
    real = there[:, :m]
    for _ in range(rounds):
        d = (c * c).sum(axis=2)[:, None, :] - 2 * np.einsum("brd,bmd->brm", x, c)  # less a row's own square, which changes no order
        d = np.where(real[:, None, :], np.round(d, DIGITS), np.inf)
        own = (d.argmin(axis=2)[:, :, None] == np.arange(m)) & there[:, :, None]
        n = own.sum(axis=1)
        c = np.einsum("brm,brd->bmd", own.astype(float), x) / np.maximum(n, 1)[:, :, None]
        empty = (n == 0) & real
        c[empty] = np.broadcast_to(x[:, :1], c.shape)[empty]
    return c
