"""Connected components of a link table, by alternating large-star and small-star steps.

Every step is an aggregate and an equi-join on ``(a, b)`` rows, so hub nodes are
pre-aggregated and their join partitions can be split; no node's neighbours are gathered.
A link table of a bounded size takes one task and no shuffle instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postwright.llm._common import discard, staged


#: Links that one task takes, at most (16 bytes each).
ONE_TASK = 200_000


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node that the pairs (i, j) connect it to."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = [np.column_stack([b.column(0).to_numpy(), b.column(1).to_numpy()]) for b in batches if b.num_rows]
    if found:
        links = np.concatenate(found)
        nodes, place = np.unique(links, return_inverse=True)
        place = place.reshape(links.shape)
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[forest(len(nodes), place[:, 0], place[:, 1])])], names=["node", "component"])


def _lower_links(links: DataFrame) -> DataFrame:
    """Links as (u, v) with v < u, each once."""
    return (
        links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(e: DataFrame) -> DataFrame:
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    others = e.join(least, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return others.union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node that has a link; component is its smallest reachable node.

    ``links`` has columns ``a`` and ``b`` of one integer type; nulls and self-links are ignored.
    Each round is written to the shared folder, so a lost executor costs one round at most.
    """
    edges = staged(_lower_links(links), "links")
    if edges.count() <= ONE_TASK:
        return edges.select(F.col("u").cast("long"), F.col("v").cast("long")).coalesce(1).mapInArrow(_whole, "node long, component long")
    seen = None
    for _ in range(max_rounds):
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark[0] == 0 or mark == seen:
            break
        seen = mark
        larger = _lower_links(_large_star(edges))
        after = staged(_lower_links(_small_star(larger)), "links")
        discard(edges)
        edges = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return nodes.union(roots)
