"""Diagnostics: hubness, firing rates, activation gaps, score mass, background statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postwright.functions.vectors import DOUBLES, dot
from postwright.operators.ordering import prefix_sums, top_k
from postwright.operators.search import contributions, dense_search
from postwright.sources.staging import staged


def hub_counts(nearest: DataFrame, entries: DataFrame) -> DataFrame:
    """(entry_id, n): how many rows of the bank have the entry among their nearest, zeros and all (A17). ``nearest``: as from ``postings.nearest_entries``."""
    n = nearest.groupBy("entry_id").agg(F.count("*").alias("n"))
    return entries.select("entry_id").join(n, "entry_id", "left").select("entry_id", F.coalesce("n", F.lit(0)).alias("n"))


def hubness(counts: DataFrame) -> DataFrame:
    """One row: population skewness, share of the top hundredth, largest, Gini."""
    moments = counts.agg(F.skewness("n").alias("skewness"), F.max("n").alias("most"), F.count("*").alias("n_entries"), F.sum("n").alias("total"))
    ordered = prefix_sums(counts, ["n", "entry_id"], {"i": F.lit(1)})  # i: how many come before
    both = ordered.join(F.broadcast(moments))
    top = F.greatest(F.lit(1), F.floor(F.col("n_entries") / 100))
    return both.agg(
        F.first("skewness").alias("skewness"),
        (F.sum(F.when(F.col("i") >= F.col("n_entries") - top, F.col("n")).otherwise(0)) / F.first("total")).alias("top1_share"),
        F.first("most").alias("most"),
        (F.sum((2 * (F.col("i") + 1) - F.col("n_entries") - 1) * F.col("n")) / (F.first("n_entries") * F.first("total"))).alias("gini"),
    )


def background(moments: DataFrame) -> DataFrame:
    """(entry_id, mean, sd): population moments of each entry's similarity to a bank (A27). ``moments``: as from ``postings.similarity_moments``."""
    mean = F.col("total") / F.col("n")
    spread = F.greatest(F.col("squares") / F.col("n") - mean * mean, F.lit(0.0))
    return moments.select("entry_id", mean.alias("mean"), F.greatest(F.sqrt(spread), F.lit(1e-12)).alias("sd"))


def tail_place(q: float, n: int) -> int:
    """Which of the largest of n similarities counts as the upper tail: max(int((1 - q) n), 8), not a percentile (A28; its value is ``postings.nth_largest``)."""
    return max(int((1 - q) * n), 8)


def below_tau(moments: DataFrame) -> DataFrame:
    """One row: percentage of similarities under the threshold that the moments were taken with."""
    return moments.agg((F.sum("below") / F.sum("n") * 100).alias("below"))


def median_gaps(stats: DataFrame, columns: list[str], least_held: int = 1, least_seen: int = 20) -> DataFrame:
    """(statistic, gap): within each decile the held-out median minus the seen one, then the median over deciles (A30). ``stats``: decile, held, columns."""
    long = stats.select("decile", "held", F.explode(F.array(*[F.struct(F.lit(c).alias("statistic"), F.col(c).cast("double").alias("v")) for c in columns])).alias("s")).select("decile", "held", "s.statistic", "s.v")
    d = long.groupBy("decile", "statistic").agg(
        F.median(F.when(F.col("held"), F.col("v"))).alias("h"), F.median(F.when(~F.col("held"), F.col("v"))).alias("s"),
        F.count(F.when(F.col("held"), 1)).alias("nh"), F.count(F.when(~F.col("held"), 1)).alias("ns"),
    )
    return d.where((F.col("nh") >= least_held) & (F.col("ns") >= least_seen)).groupBy("statistic").agg(F.median(F.col("h") - F.col("s")).alias("gap"))


def activation_gap(stats: DataFrame, value: str, least_held: int = 1, least_seen: int = 20) -> DataFrame:
    """One row: median over deciles of log(held median / seen median), its largest size, and dead rates (A29). ``stats``: decile, held, value."""
    h, s = F.col("held"), ~F.col("held")
    d = stats.groupBy("decile").agg(F.median(F.when(h, F.col(value))).alias("mh"), F.median(F.when(s, F.col(value))).alias("ms"), F.count(F.when(h, 1)).alias("nh"), F.count(F.when(s, 1)).alias("ns"))
    gaps = d.where((F.col("nh") >= least_held) & (F.col("ns") >= least_seen)).select(F.log((F.col("mh") + 1e-9) / (F.col("ms") + 1e-9)).alias("g"))
    dead = stats.agg(F.avg(F.when(h, (F.col(value) == 0).cast("double"))).alias("dead_held"), F.avg(F.when(s, (F.col(value) == 0).cast("double"))).alias("dead_seen"))
    return gaps.agg(F.median("g").alias("gap"), F.max(F.abs("g")).alias("largest")).join(F.broadcast(dead))


def decile_target(stats: DataFrame, value: str, lower: bool = False) -> DataFrame:
    """(decile, target): the seen entries' median by decile, that of all seen ones where a decile has none (A14). ``lower``: the lower of two middle values."""
    med = F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {value})") if lower else F.median(value)
    seen = stats.where("NOT held")
    own = seen.groupBy("decile").agg(med.alias("t"))
    every = seen.agg(med.alias("all_seen"))
    return stats.select("decile").distinct().join(own, "decile", "left").join(F.broadcast(every)).select("decile", F.coalesce("t", "all_seen").cast("double").alias("target"))


def score_mass(queries: DataFrame, docs: DataFrame, qrels: DataFrame, inserted: DataFrame) -> DataFrame:
    """(entry_id, relevant, irrelevant): what each inserted entry adds to scores of relevant and of other pairs."""
    q = queries.join(inserted.select("entry_id"), "entry_id", "left_semi")
    c = contributions(q, docs).join(qrels.select("qid", "pid", F.lit(1).alias("rel")), ["qid", "pid"], "left")
    m = c.groupBy("entry_id").agg(F.sum(F.when(F.col("rel") == 1, F.col("part")).otherwise(0.0)).alias("relevant"), F.sum(F.when(F.col("rel").isNull(), F.col("part")).otherwise(0.0)).alias("irrelevant"))
    return inserted.select("entry_id").join(m, "entry_id", "left").select("entry_id", F.coalesce("relevant", F.lit(0.0)).alias("relevant"), F.coalesce("irrelevant", F.lit(0.0)).alias("irrelevant"))


def lift(mass: DataFrame, base_rate: float) -> DataFrame:
    """Mass with lift, harm and whether an entry harms: it fired, and favours irrelevant pairs."""
    total = F.col("relevant") + F.col("irrelevant")
    value = F.when(total > 0, F.col("relevant") / total / base_rate)
    return mass.withColumn("lift", value).withColumns({"harmful": F.coalesce(F.col("lift") < 1, F.lit(False)), "harm": -F.log(F.greatest("lift", F.lit(1e-6)))})


def inserted_share(queries: DataFrame, docs: DataFrame, qrels: DataFrame, inserted: DataFrame, k: int = 10) -> DataFrame:
    """(rel, share): the inserted entries' part of the scores of the ``k`` best passages, relevant or not."""
    c = contributions(queries, docs).join(inserted.select("entry_id", F.lit(1).alias("ins")), "entry_id", "left")
    s = c.groupBy("qid", "pid").agg(F.round(F.sum("part"), 8).alias("score"), F.sum(F.when(F.col("ins") == 1, F.col("part")).otherwise(0.0)).alias("own"))
    best = top_k(s, ["qid"], [F.desc("score"), F.col("pid")], k)
    j = best.join(qrels.select("qid", "pid", F.lit(True).alias("r")), ["qid", "pid"], "left").withColumn("rel", F.coalesce("r", F.lit(False)))
    return j.groupBy("rel").agg(F.avg(F.col("own") / F.col("score")).alias("share"))


def firing_summary(rates: DataFrame) -> DataFrame:
    """One row over (entry_id, rate): mean, median, never, over a fifth, over half."""
    return rates.agg(
        F.avg("rate").alias("mean_rate"), F.median("rate").alias("median_rate"), F.count(F.when(F.col("rate") == 0, 1)).alias("never"),
        F.count(F.when(F.col("rate") > 0.2, 1)).alias("over_fifth"), F.count(F.when(F.col("rate") > 0.5, 1)).alias("over_half"),
    )


def held_queries(queries: DataFrame, docs: DataFrame, qrels: DataFrame, held: DataFrame, least: float = 0.2) -> DataFrame:
    """(qid, share) of judged queries whose scores on their relevant passages come from held-out entries by ``least``."""
    c = contributions(queries, docs).join(qrels.select("qid", "pid").distinct(), ["qid", "pid"], "left_semi").join(held.select("entry_id", F.lit(1).alias("h")), "entry_id", "left")
    s = c.groupBy("qid").agg(F.sum("part").alias("t"), F.sum(F.when(F.col("h") == 1, F.col("part")).otherwise(0.0)).alias("own"))
    every = qrels.select("qid").distinct().join(s, "qid", "left").select("qid", F.when(F.coalesce("t", F.lit(0.0)) > 0, F.col("own") / F.col("t")).otherwise(0.0).alias("share"))
    return every.where(F.col("share") >= least)


def lexical_held_queries(query_words: DataFrame, passage_words: DataFrame, qrels: DataFrame, held_words: DataFrame) -> DataFrame:
    """(qid): a held-out word is in the query and in a passage relevant to it (A32). Words: qid or pid, word, each once."""
    q = query_words.join(held_words.select("word"), "word", "left_semi").join(qrels, "qid")
    return q.join(passage_words, ["pid", "word"], "left_semi").select("qid").distinct()


#: Occurrences that prototypes of the stability curve are made of, and neighbours that are compared.
CURVE, NEIGHBOURS, HALF = (1, 3, 5, 10, 20, 50), 50, 50


def nested_prototypes(occurrences: DataFrame, sizes: tuple[int, ...] = CURVE, half: int = HALF) -> DataFrame:
    """(entry_id, half, k, vec): the normalised mean state of an entry's first k occurrences in each of two disjoint halves.

    ``occurrences``: entry_id, slot (from 0; a half is ``half`` slots, so that an entry has twice as many at most), state. All sizes come from one
    running sum. A half with fewer than k occurrences gives the mean of those it has, one without any no row.
    """
    rows = occurrences.where(F.col("slot") < 2 * half).groupBy("entry_id").agg(F.array_sort(F.collect_list(F.struct("slot", F.col("state").cast(DOUBLES).alias("state")))).alias("o"))
    return rows.select("entry_id", F.col("o.slot").alias("slot"), F.flatten("o.state").alias("state")).mapInArrow(_running_means(sizes, half), "entry_id int, half int, k int, vec array<double>")


def _running_means(sizes: tuple[int, ...], half: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for entry, slot, state in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                slot = slot.values.to_numpy()
                sums = np.cumsum(state.values.to_numpy().reshape(len(slot), -1), axis=0)
                for side in (0, 1):
                    first, last = np.searchsorted(slot, (side * half, (side + 1) * half))
                    for k in sizes if last > first else ():
                        end = int(np.searchsorted(slot, side * half + k))
                        if end > first:
                            total = sums[end - 1] - (sums[first - 1] if first else 0.0)
                            found.append((entry, side, k, total / max(float(np.linalg.norm(total)), 1e-12)))
            columns = list(zip(*found, strict=True)) or [(), (), (), ()]
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["entry_id", "half", "k", "vec"])

    return run


def stability_curve(prototypes: DataFrame, bank: DataFrame, dim: int, neighbours: int = NEIGHBOURS) -> DataFrame:
    """(k, n, jaccard, cosine): for each number of occurrences the mean overlap of the two prototypes' nearest bank rows and their mean cosine.

    ``prototypes``: as from ``nested_prototypes``; ``bank``: pid, vec. Neighbours are ranked inside the product; entries with one half only are left out.
    """
    both = Window.partitionBy("entry_id", "k")
    named = prototypes.withColumn("sides", F.count("*").over(both)).where("sides = 2").drop("sides")
    named = staged(named.withColumn("qid", (F.col("entry_id").cast("long") * 1000 + F.col("k")) * 2 + F.col("half")), "prototypes")
    near = dense_search(named.select("qid", "vec"), bank, dim, neighbours).select(F.expr("qid div 2").alias("pair"), "pid")
    held = near.groupBy("pair", "pid").agg(F.count("*").alias("sides")).groupBy("pair").agg(F.sum((F.col("sides") == 2).cast("long")).alias("shared"), F.count("*").alias("all"))
    one, two = (named.where(F.col("half") == h).select(F.expr("qid div 2").alias("pair"), "k", F.col("vec").alias(f"v{h}")) for h in (0, 1))
    cosine = one.join(two.drop("k"), "pair").select("pair", "k", dot("v0", "v1").alias("cosine"))
    return cosine.join(held, "pair").groupBy("k").agg(F.count("*").alias("n"), F.avg(F.col("shared") / F.col("all")).alias("jaccard"), F.avg("cosine").alias("cosine"))
