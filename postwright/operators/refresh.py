"""Entries kept up to date: only those whose occurrences changed are encoded again, every version stays readable."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postwright.functions.vectors import cosine, l2_normalise
from postwright.operators.encoder import LookupEncoder
from postwright.sources.staging import exists, staged

SCHEMA = "entry_id int, mark decimal(38,0), n long, vec array<double>, version int"


def marks(occurrences: DataFrame) -> DataFrame:
    """(entry_id, mark): what an entry's prototype rests on, as one number: the sum of hashes of its (pid, slot, vec_id)."""
    return occurrences.groupBy("entry_id").agg(F.sum(F.xxhash64("pid", "slot", "vec_id").cast("decimal(38,0)")).alias("mark"))


def versions(spark: SparkSession, folder: str) -> int:
    """How many versions are whole."""
    n = 0
    while exists(spark, f"{folder}/version={n}/_SUCCESS"):
        n += 1
    return n


def entries_at(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """(entry_id, mark, n, vec, version): each entry as it was in a version, the last one if none is named."""
    last = versions(spark, folder) - 1 if version is None else version
    if last < 0:
        return spark.createDataFrame([], SCHEMA)
    rows = spark.read.schema(SCHEMA).option("basePath", folder).parquet(*[f"{folder}/version={k}" for k in range(last + 1)])
    return rows.groupBy("entry_id").agg(F.max_by(F.struct("mark", "n", "vec", "version"), "version").alias("e")).select("entry_id", "e.*")


def refresh(folder: str, occurrences: DataFrame, encoder: LookupEncoder) -> int:
    """Write the next version: the prototypes of the entries whose occurrences are not those of the version before. Returns its number.

    ``occurrences``: entry_id, pid, slot, vec_id, as sampled now. Entries that are as they were cost a hash each and no vector. An entry that lost all its occurrences keeps its last prototype.
    A version that was broken off has no commit marker and is written again.
    """
    spark = occurrences.sparkSession
    at = versions(spark, folder)
    now = staged(marks(occurrences), "marks")
    before = entries_at(spark, folder).select("entry_id", "mark")
    todo = now.join(before, ["entry_id", "mark"], "left_anti")
    own = occurrences.join(todo.select("entry_id"), "entry_id", "left_semi").groupBy("entry_id", "vec_id").agg(F.count("*").alias("n"))
    mean = encoder.means(own, "entry_id").withColumn("vec", l2_normalise("vec"))
    sizes = own.groupBy("entry_id").agg(F.sum("n").alias("n"))
    made = mean.join(sizes, "entry_id").join(todo, "entry_id").select("entry_id", "mark", "n", "vec")
    made.write.mode("overwrite").parquet(f"{folder}/version={at}")
    return at


def drift(spark: SparkSession, folder: str, version: int) -> DataFrame:
    """(entry_id, cosine): how the entries that a version made lie to what they were before it; null for new ones."""
    new = spark.read.schema(SCHEMA).parquet(f"{folder}/version={version}").select("entry_id", F.col("vec").alias("now"))
    old = entries_at(spark, folder, version - 1).select("entry_id", F.col("vec").alias("was"))
    return new.join(old, "entry_id", "left").select("entry_id", cosine("now", "was").alias("cosine"))
