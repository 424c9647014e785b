"""Inserting entries after the fact: selection, filters, gates, calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postwright.operators.search import ranked, scores

SELECTIONS = ("df", "tfidf", "idf", "dfcap")


def select_candidates(counts: DataFrame, n_docs: int, how: str, n: int, least_df: int = 5, cap: float = 0.10) -> DataFrame:
    """(word, df, tf, value, rank): the ``n`` best words to insert, rank from 0 (G1-G4, O2). ``counts``: word, df, tf of words not known yet.

    df: passages; tfidf: tf ln(N/df); idf: the rarest first; dfcap: df without words in over a tenth of all passages.
    """
    if how not in SELECTIONS:
        raise ValueError(f"unknown selection {how}")
    c = counts.where(F.col("df") >= least_df)
    if how == "dfcap":
        c = c.where(F.col("df") <= cap * n_docs)
    idf = F.log(F.lit(float(n_docs)) / F.col("df"))
    value = {"df": F.col("df").cast("double"), "dfcap": F.col("df").cast("double"), "tfidf": F.round(F.col("tf") * idf, 8), "idf": F.round(idf, 8)}[how]
    best = c.withColumn("value", value).orderBy(F.desc("value"), "word").limit(n)
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("value"), "word")  # n rows at most
    return best.select("word", "df", "tf", "value", (F.row_number().over(w) - 1).alias("rank"))


def firing_rates(postings: DataFrame, entries: DataFrame, n_texts: int) -> DataFrame:
    """(entry_id, rate): share of texts on which each entry fires, zeros and all."""
    n = postings.where("weight > 0").groupBy("entry_id").agg(F.count("*").alias("n"))
    return entries.join(n, "entry_id", "left").select("entry_id", (F.coalesce("n", F.lit(0)) / F.lit(float(n_texts))).alias("rate"))


def keep_quiet(rates: DataFrame, at_most: float) -> DataFrame:
    """Entries that fire on a share of ``at_most`` or less: 0.05 of queries (G9) or 0.10 of passages."""
    return rates.where(F.col("rate") <= at_most)


def keep_relative(rates: DataFrame, trained: DataFrame, percentile: float = 99.0) -> DataFrame:
    """Entries that fire no more than that percentile of the trained entries that fire at all."""
    limit = trained.where("rate > 0").agg(F.percentile("rate", F.lit(percentile / 100)).alias("limit"))
    return rates.join(F.broadcast(limit)).where(F.col("limit").isNull() | (F.col("rate") <= F.col("limit"))).select("entry_id", "rate")


def keep_gated(rates: DataFrame, at_most: float, gate: float = 0.01) -> DataFrame:
    """``keep_quiet``, but all of them where the mean rate is under the gate."""
    mean = rates.agg(F.avg("rate").alias("mean"))
    return rates.join(F.broadcast(mean)).where((F.col("mean") < gate) | (F.col("rate") <= at_most)).select("entry_id", "rate")


def inserted_count(queries: DataFrame, inserted: DataFrame) -> DataFrame:
    """(qid, n_ins): inserted entries that fire on each query."""
    q = queries.where("weight > 0").join(inserted.select("entry_id", F.lit(1).alias("ins")), "entry_id", "left")
    return q.groupBy("qid").agg(F.sum(F.coalesce("ins", F.lit(0))).alias("n_ins"))


def gate(queries: DataFrame, inserted: DataFrame, k: int, mode: str, rates: DataFrame | None = None, at_most: float = 0.05) -> DataFrame:
    """Query postings after the gate, which acts on queries with more than ``k`` inserted entries.

    all: drop them all; topk: keep the ``k`` heaviest; dfdrop: drop those that fire on over ``at_most`` of
    the passages (``rates``: entry_id, rate, an index statistic).
    """
    marks = queries.where("weight > 0").join(inserted.select("entry_id", F.lit(True).alias("ins")), "entry_id", "left").withColumn("ins", F.coalesce("ins", F.lit(False)))
    w = Window.partitionBy("qid")
    m = marks.withColumn("n_ins", F.sum(F.col("ins").cast("int")).over(w))
    acts = F.col("ins") & (F.col("n_ins") > k)
    if mode == "all":
        m = m.where(~acts)
    elif mode == "topk":
        m = m.withColumn("r", F.row_number().over(Window.partitionBy("qid", "ins").orderBy(F.desc("weight"), "entry_id"))).where(~acts | (F.col("r") <= k))
    elif mode == "dfdrop":
        if rates is None:
            raise ValueError("dfdrop needs the passages' firing rates")
        m = m.join(rates.select("entry_id", "rate"), "entry_id", "left").where(~acts | (F.coalesce("rate", F.lit(0.0)) <= at_most))
    else:
        raise ValueError(f"unknown gate {mode}")
    return m.select("qid", "entry_id", "weight")


def fallback(run: DataFrame, baseline: DataFrame, counts: DataFrame, k: int) -> DataFrame:
    """Whole rankings of the trained store for gated queries, of the extended one for others (G17). ``counts``: qid, n_ins."""
    gated = counts.where(F.col("n_ins") > k).select("qid")
    return run.join(gated, "qid", "left_anti").unionByName(baseline.join(gated, "qid", "left_semi"))


def affine_z(stats: DataFrame) -> DataFrame:
    """(entry_id, a, b): A = sd* / sd, B = mean* - mean A for held-out entries; decile medians of the seen are the targets.

    ``stats``: entry_id, decile, held, mean, sd.
    """
    from postwright.operators.diagnostics import decile_target

    t = decile_target(stats, "mean").withColumnRenamed("target", "m").join(decile_target(stats, "sd").withColumnRenamed("target", "s"), "decile")
    scale = F.col("s") / F.greatest("sd", F.lit(1e-12))
    return stats.where("held").join(t, "decile").select("entry_id", scale.alias("a"), (F.col("m") - F.col("mean") * scale).alias("b"))


def affine_tail(stats: DataFrame, alpha: float = 1.0) -> DataFrame:
    """(entry_id, a, b): A = 1, B = alpha (tail* - tail): held-out tails move to the seen ones' decile median, the lower of two middles (G24). ``stats``: entry_id, decile, held, tail."""
    from postwright.operators.diagnostics import decile_target

    t = decile_target(stats, "tail", lower=True)
    return stats.where("held").join(t, "decile").select("entry_id", F.lit(1.0).alias("a"), (alpha * (F.col("target") - F.col("tail"))).alias("b"))


def affine_self(stats: DataFrame) -> DataFrame:
    """(entry_id, a, b): scale to the decile's median self-activation; an entry that hardly activates itself stays (G22). ``stats``: entry_id, decile, held, sa."""
    from postwright.operators.diagnostics import decile_target

    t = decile_target(stats, "sa")
    return stats.where("held").join(t, "decile").select("entry_id", F.when(F.abs("sa") > 1e-6, F.col("target") / F.col("sa")).otherwise(1.0).alias("a"), F.lit(0.0).alias("b"))


def apply_affine(profile: DataFrame, affine: DataFrame) -> DataFrame:
    """Similarities a x + b for entries that have an affine map."""
    a = profile.join(affine.select("entry_id", "a", "b"), "entry_id", "left")
    return a.withColumn("sim", F.coalesce(F.col("a") * F.col("sim") + F.col("b"), F.col("sim"))).drop("a", "b")


def shift_to_frequency(profile: DataFrame, targets: DataFrame, tau: float, steps: int = 12) -> DataFrame:
    """(entry_id, shift): a fixed number of shrinking steps on each entry's similarities until its firing count meets its target.

    Similarities count by their value to four decimals, so an entry folds in one row of 20,001 values at most,
    however many texts there are. ``profile``: row, entry_id, sim (real ones, no padding); ``targets``: entry_id, target.
    """
    return shift_of_counts(profile.groupBy("entry_id", F.round("sim", 4).alias("s")).agg(F.count("*").alias("n")), targets, tau, steps)


def shift_of_counts(counts: DataFrame, targets: DataFrame, tau: float, steps: int = 12) -> DataFrame:
    """``shift_to_frequency`` of counts by entry and rounded similarity (entry_id, s, n)."""
    s = counts.join(targets, "entry_id").groupBy("entry_id", "target").agg(F.collect_list(F.struct("s", "n")).alias("sims"))

    def step(shift, i):
        over = F.aggregate("sims", F.lit(0).cast("long"), lambda t, x: t + F.when(x["s"] + shift > tau, x["n"]).otherwise(0))
        size = 0.5 / (i + 1.0)
        return F.when(over < F.col("target"), shift + size).when(over > F.col("target"), shift - size).otherwise(shift)

    return s.select("entry_id", F.aggregate(F.sequence(F.lit(0), F.lit(steps - 1)), F.lit(0.0), step).alias("shift"))


def with_and_without(queries: DataFrame, base_queries: DataFrame, docs: DataFrame, base_docs: DataFrame, k: int) -> DataFrame:
    """(system, qid, pid, score, rank): the extended store and, as an encode of its own, the trained one."""
    a = ranked(scores(queries, docs), k).withColumn("system", F.lit("with"))
    b = ranked(scores(base_queries, base_docs), k).withColumn("system", F.lit("without"))
    return a.unionByName(b)


