"""Ranking metrics, intervals, correlations, and other statistics of evaluation."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postwright.functions.hashing import md5_int
from postwright.operators.ordering import average_ranks, prefix_sums


def judged(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """The run with ``rel``, whether a passage is relevant."""
    return run.join(qrels.select("qid", "pid").distinct().withColumn("hit", F.lit(True)), ["qid", "pid"], "left").withColumn("rel", F.coalesce("hit", F.lit(False))).drop("hit")


def per_query(run: DataFrame, qrels: DataFrame, depths: tuple[int, ...] = (10, 100), cut: int = 10) -> DataFrame:
    """(qid, mrr, ndcg, r10, r100 …) of queries that are judged and have a ranking."""
    n_rel = qrels.distinct().groupBy("qid").agg(F.count("*").alias("n_rel"))
    j = judged(run, qrels)
    first = F.min(F.when(F.col("rel") & (F.col("rank") <= cut), F.col("rank")))
    gain = F.sum(F.when(F.col("rel") & (F.col("rank") <= cut), 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0))
    hits = [F.sum((F.col("rel") & (F.col("rank") <= k)).cast("int")).alias(f"h{k}") for k in depths]
    got = j.groupBy("qid").agg(first.alias("first"), gain.alias("gain"), *hits).join(n_rel, "qid")
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_rel"), F.lit(cut)).cast("int")), F.lit(0.0), lambda s, r: s + 1 / F.log2(r + 1.0))
    return got.select("qid", F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"), (F.col("gain") / ideal).alias("ndcg"), *[(F.col(f"h{k}") / F.col("n_rel")).alias(f"r{k}") for k in depths])


def mean_metrics(metrics: DataFrame) -> DataFrame:
    """One row: the means over queries, and how many there are."""
    names = [c for c in metrics.columns if c != "qid"]
    return metrics.agg(F.count("*").alias("n_queries"), *[F.avg(c).alias(c) for c in names])


#: Millionths up to which a draw is 0, 1, 2 ... of a Poisson variable of mean one.
POISSON = (367_879, 735_759, 919_699, 981_012, 996_340, 999_406, 999_917, 999_990, 999_999)


def resample_weight(b: Column, row: Column, seed: str) -> Column:
    """How often a row counts in resample b: a Poisson number of mean one from a hash, the same in any engine and on any partition."""
    u = F.pmod(md5_int(F.concat_ws("|", F.lit(seed), b.cast("string"), row.cast("string"))), F.lit(1_000_000))
    return sum(((u >= c).cast("int") for c in POISSON[1:]), (u >= POISSON[0]).cast("int"))


def resampled_means(values: DataFrame, columns: list[str], resamples: int, seed: str) -> DataFrame:
    """(b, mean of each column) over resamples of all rows (qid and columns, each qid once): every row draws its own weights, so a task adds up its
    rows and sends one sum a resample; no row is numbered or joined."""
    draws = values.select("qid", *columns, F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("b"))
    weighted = draws.withColumn("w", resample_weight(F.col("b"), F.col("qid"), seed)).where("w > 0")
    return weighted.groupBy("b").agg(*[(F.sum(F.col("w") * F.col(c)) / F.sum("w")).alias(c) for c in columns])


def drawn_means(values: DataFrame, columns: list[str], resamples: int, seed: str) -> DataFrame:
    """(b, mean of each column) over resamples that each draw as many rows as there are, with replacement (qid and columns, each qid once). Rows are numbered in order of qid over range partitions; place i of resample b holds the row that a hash names."""
    rows = prefix_sums(values.select("qid", *columns), ["qid"], {"i": F.lit(1)}).withColumn("i", F.col("i").cast("long"))
    n = rows.agg(F.count("*").alias("n"))
    draws = rows.select(F.col("i").alias("place"), F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("b")).join(F.broadcast(n))
    drawn = draws.select("b", F.pmod(md5_int(F.concat_ws("|", F.lit(seed), F.col("b").cast("string"), F.col("place").cast("string"))), F.col("n")).alias("i"))
    return drawn.join(rows.select("i", *columns), "i").groupBy("b").agg(*[F.avg(c).alias(c) for c in columns])


def bootstrap_interval(values: DataFrame, column: str, resamples: int = 1000, seed: str = "boot", level: float = 0.95) -> DataFrame:
    """One row: mean, lo, hi, with linearly interpolated quantiles."""
    tail = (1 - level) / 2
    means = drawn_means(values, [column], resamples, seed)
    q = means.agg(F.percentile(column, F.lit(tail)).alias("lo"), F.percentile(column, F.lit(1 - tail)).alias("hi"))
    return values.agg(F.avg(column).alias("mean")).join(F.broadcast(q)).select("mean", "lo", "hi")


def paired_bootstrap(a: DataFrame, b: DataFrame, column: str, resamples: int = 1000, seed: str = "pair") -> DataFrame:
    """One row: diff (a - b), lo, hi, p (two-sided, 1 at most), excludes_zero, over the queries that both have."""
    d = a.select("qid", F.col(column).alias("x")).join(b.select("qid", F.col(column).alias("y")), "qid").select("qid", (F.col("x") - F.col("y")).alias("d"))
    means = resampled_means(d, ["d"], resamples, seed)
    q = means.agg(
        F.percentile("d", F.lit(0.025)).alias("lo"), F.percentile("d", F.lit(0.975)).alias("hi"),
        F.least(F.lit(1.0), 2 * F.least(F.avg((F.col("d") <= 0).cast("double")), F.avg((F.col("d") >= 0).cast("double")))).alias("p"),
    )
    return d.agg(F.avg("d").alias("diff")).join(F.broadcast(q)).select("diff", "lo", "hi", "p", ((F.col("lo") > 0) | (F.col("hi") < 0)).alias("excludes_zero"))


def recovery_ratio(model_all: DataFrame, model_seen: DataFrame, oracle_all: DataFrame, oracle_seen: DataFrame, column: str, resamples: int = 1000, seed: str = "rho", least: float = 0.02) -> DataFrame:
    """One row: rho = mean(model_all - model_seen) / mean(oracle_all - oracle_seen), its interval, and whether the denominator supports it."""
    frames = {"ma": model_all, "ms": model_seen, "oa": oracle_all, "os": oracle_seen}
    joined = None
    for name, f in frames.items():
        f = f.select("qid", F.col(column).alias(name))
        joined = f if joined is None else joined.join(f, "qid")
    d = joined.select("qid", (F.col("ma") - F.col("ms")).alias("num"), (F.col("oa") - F.col("os")).alias("den"))
    means = resampled_means(d, ["num", "den"], resamples, seed).withColumn("rho", F.when(F.abs("den") > 1e-12, F.col("num") / F.col("den")))
    q = means.agg(F.percentile("rho", F.lit(0.025)).alias("lo"), F.percentile("rho", F.lit(0.975)).alias("hi"), F.percentile("den", F.lit(0.025)).alias("den_lo"), F.percentile("den", F.lit(0.975)).alias("den_hi"))
    m = d.agg(F.avg("num").alias("num"), F.avg("den").alias("den"), F.count("*").alias("n"))
    return m.join(F.broadcast(q)).select("n", F.when(F.abs("den") > 1e-12, F.col("num") / F.col("den")).alias("rho"), "lo", "hi", ((F.col("den") >= least) & ((F.col("den_lo") > 0) | (F.col("den_hi") < 0))).alias("valid"))


def spearman(rows: DataFrame, x: str, y: str, by: list[str], least: int = 0) -> DataFrame:
    """(by, n, rho): correlation of average ranks within groups of more than ``least`` rows."""
    r = average_ranks(average_ranks(rows, x, by, "rx"), y, by, "ry")
    return r.groupBy(*by).agg(F.count("*").alias("n"), F.corr("rx", "ry").alias("rho")).where(F.col("n") > least)


def spearman_ordinal(rows: DataFrame, x: str, y: str, by: list[str], tie: str) -> DataFrame:
    """The variant whose ties are broken by order."""
    w = Window.partitionBy(*by)
    r = rows.withColumns({"rx": F.row_number().over(w.orderBy(x, tie)), "ry": F.row_number().over(w.orderBy(y, tie))})
    return r.groupBy(*by).agg(F.count("*").alias("n"), F.corr("rx", "ry").alias("rho"))


def auc(rows: DataFrame, score: str, label: str) -> DataFrame:
    """One row: exact area under the curve with half for ties, null for a single class.

    Counted by distinct score, cumulated over range partitions: no task holds all scores.
    """
    counts = rows.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(score).alias("s")).agg(
        F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("pos"), F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).alias("neg")
    )
    cum = prefix_sums(counts, ["s"], {"below": F.col("neg")})
    t = cum.agg(F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2.0)).alias("u"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    return t.select("n_pos", "n_neg", F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("u") / (F.col("n_pos").cast("double") * F.col("n_neg"))).alias("auc"))


def wasserstein(rows: DataFrame, value: str, side: str, by: list[str]) -> DataFrame:
    """(by, w1): distance between the distributions of ``value`` on the two sides (0 and 1) of each group.

    Counted by distinct value, cumulated inside groups over range partitions: no task holds a group.
    """
    n = rows.groupBy(*by, F.col(value).alias("v")).agg(F.sum(F.when(F.col(side) == 0, 1).otherwise(0)).alias("a"), F.sum(F.when(F.col(side) == 1, 1).otherwise(0)).alias("b"))
    c = prefix_sums(n, ["v"], {"ba": F.col("a"), "bb": F.col("b")}, by, following="v")
    sizes = n.groupBy(*by).agg(F.sum("a").alias("na"), F.sum("b").alias("nb")).select(*[F.col(k).alias(f"of_{k}") for k in by], "na", "nb").where("na > 0 AND nb > 0")
    same = functools.reduce(lambda x, k: x & F.col(k).eqNullSafe(F.col(f"of_{k}")), by, F.lit(True))
    apart = F.abs((F.col("ba") + F.col("a")) / F.col("na") - (F.col("bb") + F.col("b")) / F.col("nb")) * (F.col("next_v") - F.col("v"))
    return c.join(sizes, same).groupBy(*by).agg(F.sum(F.coalesce(apart, F.lit(0.0))).alias("w1"))


def tail_mean(history: DataFrame, order: str, value: str, last: int = 10) -> DataFrame:
    """The mean of the last records of a log."""
    return history.orderBy(F.desc(order)).limit(last).agg(F.avg(value).alias("mean"))


def best_cell(rows: DataFrame, cell: str, value: str) -> DataFrame:
    """The cell of the largest value, the first among equals."""
    return rows.orderBy(F.desc(value), cell).limit(1)
