"""A stored inverted index of weights, searched exactly without scoring what cannot be among the best.

Texts are put in order of their heaviest entry and cut into blocks of equal size. A row of the index is one entry's postings in one block with the
largest weight among them, and rows lie in order of entry and block. A search first reads the largest weights alone: their products with the
query's weights, added up, bound the score of any text of the block. The blocks with the highest bounds are scored, which gives each query a score that its k-th
best text reaches at least; of all other blocks only those whose bound reaches it are scored too. Two rounds, whatever the
data; a frequent entry costs a query one row a block in the first and the texts of few blocks in the second.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postwright.operators.ordering import prefix_sums, top_k
from postwright.operators.postings import DIGITS
from postwright.operators.search import ranked
from postwright.sources.staging import exists, staged

#: Texts of a block.
BLOCK = 64
#: Blocks of each query that are scored first, at least.
SEEDS = 4
#: Bounds and scores are sums in any order; a bound counts as reaching a score that it misses by less.
SLACK = 1e-7


@dataclass(frozen=True)
class ImpactIndex:
    """``lists``: entry_id, block, most, hits (slot, weight); ``places``: block, slot, pid."""

    lists: DataFrame
    places: DataFrame
    block: int


@dataclass(frozen=True)
class Found:
    """``run``: qid, pid, score, rank; ``work``: qid, blocks (that hold an entry of the query), opened (that were scored)."""

    run: DataFrame
    work: DataFrame


def build(postings: DataFrame, folder: str, block: int = BLOCK) -> ImpactIndex:
    """Write the index of (pid, entry_id, weight), each pair once, into ``folder``; weights that are not over zero are left out. The settings come last and say that it is whole."""
    spark = postings.sparkSession
    p = postings.where("weight > 0").select(F.col("pid").cast("long").alias("pid"), F.col("entry_id").cast("int").alias("entry_id"), F.col("weight").cast("double").alias("weight"))
    heaviest = p.groupBy("pid").agg(F.max_by("entry_id", F.struct("weight", -F.col("entry_id"))).alias("first"))
    order = prefix_sums(heaviest, ["first", "pid"], {"i": F.lit(1)})
    places = staged(order.select("pid", F.expr(f"cast(i div {block} as long)").alias("block"), F.expr(f"cast(i % {block} as int)").alias("slot")), "places")
    lists = p.join(places, "pid").groupBy("entry_id", "block").agg(F.max("weight").alias("most"), F.array_sort(F.collect_list(F.struct("slot", "weight"))).alias("hits"))
    lists.repartitionByRange("entry_id", "block").sortWithinPartitions("entry_id", "block").write.mode("overwrite").parquet(f"{folder}/lists")
    places.select("block", "slot", "pid").repartitionByRange("block").sortWithinPartitions("block", "slot").write.mode("overwrite").parquet(f"{folder}/places")
    spark.createDataFrame([(block,)], "block int").coalesce(1).write.mode("overwrite").parquet(f"{folder}/settings")
    return open_index(spark, folder)


def is_built(spark: SparkSession, folder: str) -> bool:
    return exists(spark, f"{folder}/settings/_SUCCESS")


def open_index(spark: SparkSession, folder: str) -> ImpactIndex:
    if not is_built(spark, folder):
        raise FileNotFoundError(f"no whole index in {folder}")
    lists = spark.read.schema("entry_id int, block long, most double, hits array<struct<slot:int,weight:double>>").parquet(f"{folder}/lists")
    places = spark.read.schema("block long, slot int, pid long").parquet(f"{folder}/places")
    return ImpactIndex(lists, places, spark.read.parquet(f"{folder}/settings").first().block)


def bounds(index: ImpactIndex, queries: DataFrame) -> DataFrame:
    """(qid, block, bound): what a text of the block can score at most. Reads no postings."""
    q = queries.where("weight > 0").select("qid", "entry_id", F.col("weight").alias("qw"))
    most = index.lists.select("entry_id", "block", "most")
    return q.join(most, "entry_id").groupBy("qid", "block").agg(F.round(F.sum(F.col("qw") * F.col("most")), DIGITS).alias("bound"))


def scored(index: ImpactIndex, queries: DataFrame, pairs: DataFrame) -> DataFrame:
    """(qid, pid, score) of the texts of given (qid, block) pairs that share an entry with the query."""
    q = queries.where("weight > 0").select("qid", "entry_id", F.col("weight").alias("qw"))
    hits = pairs.select("qid", "block").join(q, "qid").join(index.lists.select("entry_id", "block", "hits"), ["entry_id", "block"]).select("qid", "block", "qw", F.explode("hits").alias("hit"))
    sums = hits.groupBy("qid", "block", F.col("hit.slot").alias("slot")).agg(F.round(F.sum(F.col("qw") * F.col("hit.weight")), DIGITS).alias("score"))
    return sums.join(index.places, ["block", "slot"]).select("qid", "pid", "score")


def search(index: ImpactIndex, queries: DataFrame, k: int, seeds: int = SEEDS) -> Found:
    """The ``k`` best texts of each query (qid, entry_id, weight), the same rows as ``search.search`` of the postings gives."""
    first = max(seeds, -(-k // index.block))
    every = staged(bounds(index, queries), "bounds")
    chosen = staged(top_k(every, ["qid"], [F.desc("bound"), F.col("block")], first).select("qid", "block"), "seeds")
    known = staged(ranked(scored(index, queries, chosen), k), "known")
    least = known.where(F.col("rank") == k).select("qid", F.col("score").alias("least"))
    others = every.join(chosen, ["qid", "block"], "left_anti").join(least, "qid", "left").where(F.col("least").isNull() | (F.col("bound") + SLACK >= F.col("least")))
    others = staged(others.select("qid", "block"), "reached")
    run = ranked(known.drop("rank").union(scored(index, queries, others)), k)
    opened = chosen.union(others).groupBy("qid").agg(F.count("*").alias("opened"))
    return Found(run, every.groupBy("qid").agg(F.count("*").alias("blocks")).join(opened, "qid"))
