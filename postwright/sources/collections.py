"""Collections, queries, judgements and runs in the text formats of retrieval benchmarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_collection(spark: SparkSession, path: str) -> DataFrame:
    """(pid, text) from lines ``pid<TAB>text``; a text may hold further tabs."""
    parts = F.split("value", "\t", 2)
    return spark.read.text(path).select(parts[0].cast("long").alias("pid"), parts[1].alias("text"))


def is_contiguous(passages: DataFrame) -> DataFrame:
    """One row: n, and whether the ids are 0 to n - 1."""
    return passages.agg(F.count("*").alias("n"), ((F.count("*") == F.countDistinct("pid")) & (F.min("pid") == 0) & (F.max("pid") + 1 == F.count("*"))).alias("contiguous"))


def lookup(passages: DataFrame, ids: DataFrame) -> DataFrame:
    """The passages asked for, repeats and all (S2). ``ids``: pid."""
    return ids.join(passages, "pid")


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """(qid, text, ord) from lines ``qid<TAB>text``; ord keeps the order of lines (S3)."""
    parts = F.split("value", "\t", 2)
    return spark.read.text(path).select(parts[0].cast("long").alias("qid"), parts[1].alias("text"), F.monotonically_increasing_id().alias("ord"))


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """(qid, pid) from white-space separated lines ``qid _ pid rel``; the grade is ignored, repeats collapse."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where("trim(value) <> ''").select(parts[0].cast("long").alias("qid"), parts[2].cast("long").alias("pid")).distinct()


def qrels_sets(qrels: DataFrame) -> DataFrame:
    """(qid, pids): the relevant passages of each query, sorted."""
    return qrels.groupBy("qid").agg(F.array_sort(F.collect_set("pid")).alias("pids"))


def titled_text(title: Column, text: Column) -> Column:
    return F.trim(F.concat_ws(" ", F.when(title != "", title), text))


def read_domain(spark: SparkSession, folder: str, split: str = "test") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(corpus, queries, qrels) of a JSONL data set: titles join texts; only judged queries and grades over zero stay."""
    corpus = spark.read.schema("_id string, title string, text string").json(f"{folder}/corpus.jsonl").select(
        F.col("_id").alias("doc"), titled_text(F.col("title"), F.col("text")).alias("text")
    )
    queries = spark.read.schema("_id string, text string").json(f"{folder}/queries.jsonl").select(F.col("_id").alias("query"), "text")
    qrels = (
        spark.read.csv(f"{folder}/qrels/{split}.tsv", sep="\t", header=True, schema="query string, doc string, rel int")
        .where("rel > 0").select("query", "doc")
        .join(queries, "query", "left_semi").join(corpus, "doc", "left_semi")
    )
    return corpus, queries.join(qrels, "query", "left_semi"), qrels


def numbered(rows: DataFrame, key: str, name: str) -> DataFrame:
    """String ids to numbers from 0 in key order (S7), without one global task."""
    from postwright.operators.ordering import prefix_sums

    return prefix_sums(rows.select(key).distinct(), [key], {name: F.lit(1)})


def write_run(run: DataFrame, path: str) -> None:
    """A run as (qid, rank, pid, score), nothing padded."""
    run.select("qid", "rank", "pid", "score").write.mode("overwrite").parquet(path)


def write_jsonl(passages: DataFrame, path: str) -> None:
    """``{"id", "contents"}`` lines for an outside indexer."""
    passages.select(F.col("pid").cast("string").alias("id"), F.col("text").alias("contents")).write.mode("overwrite").json(path)
