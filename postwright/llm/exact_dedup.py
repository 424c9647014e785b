"""Exact dedup by content-defined chunk recipes.

Each text is cut into chunks at places that its own content fixes, a chunk becomes a 64-bit
identifier, and a text becomes the ordered list of its identifiers (its recipe). Texts are
compared as recipes: about one hundredth of their bytes move, and each long text is read
once. Identifiers are verified against the chunks' SHA-256: chunks that share an identifier
but not a digest get an ordinal beside it, so no two distinct chunks look alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postwright.llm._common import BROADCAST_IDS, anti, ascii_lower, only, sent_or_shuffled, staged, unused

#: A chunk ends after a character pair that comes about every hundred characters of prose.
BREAK = r"(?<=[^a-z][a-z][^a-z])"


def chunk_pattern(smallest: int = 900, largest: int = 8000) -> str:
    """Matches one chunk: the first break after ``smallest`` characters, else ``largest`` characters, else the rest."""
    return f"(?s).{{{smallest},{largest}}}?{BREAK}|.{{1,{largest}}}"


def chunk_recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", id_bits: int = 64,
                  smallest: int = 900, largest: int = 8000) -> DataFrame:
    """(doc_id, text_sha256, ids, digests): one scan of the texts, all that later steps need.

    ``id_bits`` below 64 truncates identifiers (to test what happens when they collide).
    """
    kept = shift = 64 - id_bits
    d = only(docs, doc_id=id_col, text=text_col).select("doc_id", ascii_lower(F.col("text")).alias("norm"))
    d = d.select(
        "doc_id",
        F.sha2("norm", 256).alias("text_sha256"),
        F.regexp_extract_all("norm", F.lit(chunk_pattern(smallest, largest)), F.lit(0)).alias("chunks"),
    )
    ident = lambda c: F.shiftrightunsigned(F.xxhash64(c), shift) if kept else F.xxhash64(c)
    return d.select(
        "doc_id",
        "text_sha256",
        F.transform("chunks", ident).alias("ids"),
        F.transform("chunks", lambda c: F.unhex(F.sha2(c, 256))).alias("digests"),
    )


def _verified(recipes: DataFrame) -> DataFrame:
    """(doc_id, text_sha256, recipe): identifiers, with an ordinal where distinct chunks share one."""
    chunk = F.explode(F.arrays_zip("ids", "digests")).alias("c")
    distinct = recipes.select(chunk).select(F.col("c.ids").alias("id"), F.col("c.digests").alias("digest")).distinct()
    shared = distinct.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")
    ordinals = staged(
        distinct.join(shared, "id", "left_semi")
        .groupBy("id").agg(F.array_sort(F.collect_set("digest")).alias("known")),
        "collisions",
    )
    plain = recipes.select(
        "doc_id", "text_sha256", F.transform("ids", lambda i: F.struct(i.alias("id"), F.lit(0).alias("k"))).alias("recipe")
    )
    if ordinals.isEmpty():
        return plain
    own = F.col("doc_id").cast("string")
    keyed = recipes.withColumn("row", F.concat(F.when(own.isNull(), "n").otherwise(F.concat(F.lit("v"), own)), F.lit("/"), "text_sha256"))
    hit = keyed.select("row", F.explode(F.array_distinct("ids")).alias("id")).join(ordinals, "id", "left_semi").select("row").distinct()
    fixed = (
        keyed.join(hit, "row", "left_semi").dropDuplicates(["row"])
        .select("row", F.posexplode(F.arrays_zip("ids", "digests")).alias("p", "c"))
        .select("row", "p", F.col("c.ids").alias("id"), F.col("c.digests").alias("digest"))
        .join(ordinals, "id", "left")
        .select("row", F.struct("p", F.struct("id", F.coalesce(F.array_position("known", F.col("digest")).cast("int"), F.lit(0)).alias("k")).alias("e")).alias("x"))
        .groupBy("row").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["e"]).alias("fixed"))
    )
    return (
        keyed.select("row", "doc_id", "text_sha256", F.transform("ids", lambda i: F.struct(i.alias("id"), F.lit(0).alias("k"))).alias("recipe"))
        .join(fixed, "row", "left")
        .select("doc_id", "text_sha256", F.coalesce("fixed", "recipe").alias("recipe"))
    )


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", id_bits: int = 64,
                     smallest: int = 900, largest: int = 8000) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; the largest doc_id of equal texts stays.
    Null text counts as empty. A null doc_id never stays unless its whole group has none
    (keep_id is then null and kept false). Repeated rows count in group_size, and all rows that
    carry the id that stays are kept. An empty table gives an empty result; other columns are ignored.
    """
    recipes = staged(chunk_recipes(docs, id_col, text_col, id_bits, smallest, largest), "recipes")
    rows = _verified(recipes).withColumn("key", F.xxhash64("recipe"))
    # Written, so that the join's two sides are plain shuffles and a hot group's rows can be split among tasks.
    groups = staged(rows.groupBy("key", "recipe").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "groups")
    return rows.join(groups, ["key", "recipe"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"),
        "text_sha256",
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts; every column stays.

    Rows are dropped by id (null included) and text, so a repeated id costs no other text. Of rows that share the id
    that stays as well as the text, or of a group without ids, any one stays.
    """
    rows = staged(exact_duplicates(docs, id_col, text_col), "exact-rows")
    key = ("doc_id", "text_sha256")
    replaced = rows.where("NOT kept AND keep_id IS NOT NULL").select(*key).distinct()
    repeated = rows.where("kept OR keep_id IS NULL").groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*key)
    most = BROADCAST_IDS // 8  # a digest is as large as eight ids
    digest = F.sha2(ascii_lower(F.col(f"`{text_col}`")), 256)
    same = [(id_col, "doc_id"), (digest, "text_sha256")]
    out = anti(docs, same, sent_or_shuffled(replaced, "dropped", most))
    if repeated.isEmpty():
        return out
    again, mark = sent_or_shuffled(repeated, "repeated", most), unused(docs, 1)[0]
    one = anti(out, same, again, "left_semi").withColumn(mark, digest).dropDuplicates([id_col, mark]).drop(mark)
    return anti(out, same, again).union(one)
