"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postwright.sources.staging import remove, shared_dir, staged  # noqa: F401

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: Rows and bytes of one Arrow batch sent to Python, so that a batch of long texts stays small.
ARROW_ROWS = 1000
ARROW_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; null counts as empty.

    ``lower`` is exact where every character is one byte, and much faster than ``translate``.
    """
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def id_crc(id_col: Column) -> Column:
    """crc32 of the id written as text (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary"))


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds, for this session from here on (plans are lazy and read the setting when they run); a smaller setting of the user stays."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)):
        if not 0 < int(spark.conf.get(key).rstrip("b")) <= most:
            spark.conf.set(key, str(most))


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/postwright/{name}-{uuid.uuid4().hex}"


def discard(df: DataFrame) -> None:
    """Remove the files of a staged table that nothing will read again."""
    spark = df.sparkSession
    own = f"{shared_dir(spark)}/postwright/".split(":", 1)[-1].lstrip("/")
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if own in folder:
            remove(spark, folder)


#: Ids that may be sent to all executors at once (8 bytes each, about 64 MB as a hash table).
BROADCAST_IDS = 1_000_000


def only(df: DataFrame, **columns: str) -> DataFrame:
    """Just the named input columns under the given names, so that no other column can clash."""
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in columns.items()])


def sent_or_shuffled(rows: DataFrame, name: str, most: int | None = None) -> DataFrame:
    """The side of a join, written and counted: few rows are sent to where the texts are, more than ``most`` are left to a shuffle join."""
    rows = staged(rows, name)
    return F.broadcast(rows) if rows.count() <= (BROADCAST_IDS if most is None else most) else rows


def without_rows(docs: DataFrame, id_col: str, text_col: str, dropped: DataFrame) -> DataFrame:
    """``docs`` without the rows whose id (null included) and ``xxhash64`` of the text are in ``dropped`` (``id``, ``hash``).

    Rows are told apart by id and text, so a repeated id costs no other text. Columns of ``docs`` may have any names.
    """
    found = sent_or_shuffled(dropped.select("id", "hash").distinct(), "dropped")
    return anti(docs, [(id_col, "id"), (F.xxhash64(F.col(f"`{text_col}`")), "hash")], found)


def anti(docs: DataFrame, keys: list, found: DataFrame, how: str = "left_anti") -> DataFrame:
    """``docs`` joined by null-safe keys (a column's name or an expression of ``docs``, a name in ``found``); names that no column of ``docs`` has stand between."""
    fresh = unused(docs, len(keys) * 2)
    left, right = fresh[: len(keys)], fresh[len(keys) :]
    own = docs.select("*", *[(F.col(f"`{k}`") if isinstance(k, str) else k).alias(n) for (k, _), n in zip(keys, left, strict=True)])
    other = found.select(*[F.col(k).alias(n) for (_, k), n in zip(keys, right, strict=True)])
    same = F.lit(True)
    for a, b in zip(left, right, strict=True):
        same = same & F.col(a).eqNullSafe(F.col(b))
    return own.join(other, same, how).drop(*left)


def unused(df: DataFrame, n: int) -> list[str]:
    """Names that no column of ``df`` has, in any case."""
    taken = {c.lower() for c in df.columns}
    return [c for k in range(n + len(taken)) if (c := f"own_{k}") not in taken][:n]
