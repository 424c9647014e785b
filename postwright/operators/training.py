"""Losses and masks of training, as metrics over batches of representations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postwright.functions.hashing import md5_int


def flops(postings: DataFrame, n_texts: int) -> DataFrame:
    """One row: the sum over entries of the squared mean weight."""
    return postings.groupBy("entry_id").agg((F.sum("weight") / F.lit(float(n_texts))).alias("m")).agg(F.sum(F.col("m") * F.col("m")).alias("flops"))


def info_nce(scored: DataFrame, positives: DataFrame) -> DataFrame:
    """One row: mean cross-entropy of the positive among each query's candidates (X2). ``scored``: qid, pid, score; ``positives``: qid, pid."""
    m = scored.groupBy("qid").agg(F.max("score").alias("m"))
    z = scored.join(m, "qid").groupBy("qid", "m").agg(F.sum(F.exp(F.col("score") - F.col("m"))).alias("z"))
    own = scored.join(positives, ["qid", "pid"], "left_semi").select("qid", "score")
    return own.join(z, "qid").agg(F.avg(F.log("z") + F.col("m") - F.col("score")).alias("loss"), F.count("*").alias("n"))


def calibration_loss(stats: DataFrame, eps: float = 1e-6) -> DataFrame:
    """One row: mean over deciles of the squared log ratio of mean firing, held-out to trained (X3). ``stats``: decile, held, mean."""
    d = stats.groupBy("decile").agg(F.avg(F.when(F.col("held"), F.col("mean"))).alias("h"), F.avg(F.when(~F.col("held"), F.col("mean"))).alias("s")).where("h IS NOT NULL AND s IS NOT NULL")
    g = F.log(F.col("h") + eps) - F.log(F.col("s") + eps)
    return d.agg(F.avg(g * g).alias("loss"), F.count("*").alias("deciles"))


def dropout_mask(entries: DataFrame, step: int, share: float = 0.3, unit: str = "entry_id") -> DataFrame:
    """Entries kept at a training step: a hash of the step and the entry, or of its cluster."""
    draw = F.pmod(md5_int(F.concat_ws("|", F.lit(f"drop/{step}"), F.col(unit).cast("string"))), F.lit(1_000_000)) / 1e6
    return entries.where(draw >= share)


def sweep_choice(runs: DataFrame, doc_target: float = 120, query_target: float = 30) -> DataFrame:
    """The run whose densities are closest to their targets on a log scale, the first among equals (X8). ``runs``: name, nnz_d, nnz_q."""
    d = F.abs(F.log((F.col("nnz_d") + 1) / doc_target)) + F.abs(F.log((F.col("nnz_q") + 1) / query_target))
    return runs.withColumn("distance", d).orderBy("distance", "name").limit(1)
