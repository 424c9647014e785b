"""Global order without one global task: prefix sums and ranks over range partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postwright.sources.staging import staged


def prefix_sums(rows: DataFrame, order: list[str], values: dict[str, Column], by: list[str] | tuple[str, ...] = (), following: str | None = None) -> DataFrame:
    """``rows`` with, for each value, the sum over all rows before it in ``order`` (which must be unique), inside its group where ``by`` names one.

    Rows are range-partitioned by group and order and written once; each partition sums its own, and the
    totals of a partition and group are added by a join of one row each. ``following``: a column whose value in the next row of the group is added as ``next_`` and its name, null in the last.
    """
    ranged = rows.withColumns({f"__{k}": v for k, v in values.items()}).repartitionByRange(*by, *order).withColumn("__part", F.spark_partition_id())
    ranged = staged(ranged, "ranged")
    totals = [F.sum(f"__{k}").alias(f"__t_{k}") for k in values]
    if following:
        totals.append(F.min_by(following, F.struct(*order)).alias("__first"))
    per_part = ranged.groupBy("__part", *by).agg(*totals)
    every = Window.partitionBy(*by) if by else Window
    before = every.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    after = [F.lead("__first").over(every.orderBy("__part")).alias("__after")] if following else []
    offsets = per_part.select(F.col("__part").alias("__of"), *[F.col(k).alias(f"__of_{k}") for k in by], *[F.coalesce(F.sum(f"__t_{k}").over(before), F.lit(0)).alias(f"__o_{k}") for k in values], *after)
    inside = Window.partitionBy("__part", *by).orderBy(*order)
    same = F.col("__part") == F.col("__of")
    for k in by:
        same = same & F.col(k).eqNullSafe(F.col(f"__of_{k}"))
    out = ranged.join(offsets if by else F.broadcast(offsets), same)
    out = out.withColumns({k: F.coalesce(F.sum(f"__{k}").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col(f"__o_{k}") for k in values})
    if following:
        out = out.withColumn(f"next_{following}", F.coalesce(F.lead(following).over(inside), F.col("__after"))).drop("__after")
    return out.drop("__part", "__of", *[f"__of_{k}" for k in by], *[f"__{k}" for k in values], *[f"__o_{k}" for k in values])


def average_ranks(rows: DataFrame, value: str, by: list[str], name: str) -> DataFrame:
    """Average rank from 1 within ``by``, ties sharing theirs."""
    w = Window.partitionBy(*by)
    return rows.withColumn(name, F.rank().over(w.orderBy(value)) + (F.count("*").over(w.partitionBy(*by, value)) - 1) / 2.0)


def top_k(rows: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` of each group with their rank from 1 (W3, W4, W11). The planner limits groups before the shuffle."""
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)

