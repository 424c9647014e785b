"""Polysemy sampling (E6) and expansion sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postwright.functions.hashing import sample_key
from postwright.operators.ordering import top_k


def mined_senses(pairs: DataFrame, vocab: DataFrame, words: int = 20) -> DataFrame:
    """(word, sense, term): the two most frequent successors of each of the ``words`` most frequent words that have two, as the words that tell its senses apart.

    ``pairs``: word, next, n, how often one word follows another; ``vocab``: entry_id, word, is_stop. Stop words are neither words nor terms, a word is no term of its own.
    """
    v = vocab.where("NOT is_stop").select("word", "entry_id")
    known = pairs.join(v, "word").join(v.select(F.col("word").alias("next")), "next", "left_semi").where("next <> word")
    two = top_k(known, ["word"], [F.desc("n"), F.col("next")], 2)
    both = two.where("rank = 2").orderBy("entry_id").limit(words).select("word")
    return two.join(both, "word", "left_semi").select("word", F.when(F.col("rank") == 1, "A").otherwise("B").alias("sense"), F.col("next").alias("term"))


def sense_anchors(senses: DataFrame, pairs: DataFrame, vocab: DataFrame, most: int = 5) -> DataFrame:
    """(word, anchor_sense, entry_id): the vocabulary words that most often follow a sense's term."""
    after = senses.join(pairs.select(F.col("word").alias("term"), "next", "n"), "term").where("next <> word AND next <> term")
    after = after.join(vocab.select(F.col("word").alias("next"), "entry_id"), "next")
    return top_k(after, ["word", "sense"], [F.desc("n"), F.col("next")], most).select("word", F.col("sense").alias("anchor_sense"), "entry_id")


def sense_sample(labelled: DataFrame, most: int = 40, seed: str = "sense") -> DataFrame:
    """(word, sense, pid, slot): passages of each word's sense, drawn by hash, slot from 0 (E6). ``labelled``: pid, word, sense."""
    drawn = labelled.withColumn("h", sample_key(seed, "word", "sense", "pid"))
    return top_k(drawn, ["word", "sense"], [F.col("h"), F.col("pid")], most, "slot").select("word", "sense", "pid", (F.col("slot") - 1).alias("slot"))


def thin_senses(sampled: DataFrame, senses: DataFrame, least: int = 40) -> DataFrame:
    """(word, sense, n): senses with fewer passages than asked for."""
    n = sampled.groupBy("word", "sense").agg(F.count("*").alias("n"))
    return senses.select("word", "sense").distinct().join(n, ["word", "sense"], "left").select("word", "sense", F.coalesce("n", F.lit(0)).alias("n")).where(F.col("n") < least)


def expansions(postings: DataFrame, sample: DataFrame, k: int = 50) -> DataFrame:
    """The ``k`` heaviest entries of sampled passages."""
    own = postings.drop("rank").join(sample.select("pid"), "pid", "left_semi")
    return top_k(own, ["pid"], [F.desc("weight"), F.col("entry_id")], k)
