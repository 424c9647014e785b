"""A Merkle manifest of a dataset: one digest for the whole, and for each row the siblings that prove it.

Every row is a leaf. The leaves of a language stand in order of doc_id; runs of eight nodes
become parents level by level until one node, the subroot, is left, and the subroots become the root
in the same way. Order is a range shuffle whose partitions count their own rows, so no task holds a
language. Levels go up as runs (one row a run, its children in an array of eight at most) and proofs come down the same
way: a run takes over its parent's path and adds the parent's siblings, so that each level's join is an
eighth of the one below and the last holds one row for eight leaves. Digests travel as 32 bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postwright.llm._common import ascii_lower, discard, id_crc, only, staged

FANOUT = 8
#: A document whose id's crc32 this divides is tampered with.
TAMPERED = 3


def digest(data: Column) -> Column:
    """32 bytes: the sha256 of a text or of bytes."""
    return F.unhex(F.sha2(data, 256))


def as_text(digests: Column) -> Column:
    """Digests, one or several in a row, as lowercase hex text."""
    return F.lower(F.hex(digests))


def field(value: Column) -> Column:
    """A value as it enters a leaf: ``-`` for null, else its UTF-8 length, a colon and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaves(docs: DataFrame, tampered: int = TAMPERED) -> DataFrame:
    """(doc_id, lang key, leaf, found): ``found`` is the leaf of the text as it is found, lower-cased where tampered with. One read of the texts."""
    d = only(docs, **{c: c for c in ("doc_id", "source", "lang", "n_chars", "text")})
    head = F.concat(*[field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")])
    leaf = digest(F.concat(head, field(F.col("text"))))
    lowered = F.when(F.col("text").isNotNull(), ascii_lower(F.col("text")))
    return d.select(
        "doc_id",
        F.coalesce(F.concat(F.lit("v"), F.col("lang").cast("string")), F.lit("n")).alias("part"),  # null sorts before any value
        leaf.alias("leaf"),
        F.when(id_crc(F.col("doc_id")) % tampered == 0, digest(F.concat(head, field(lowered)))).alias("found"),
        F.monotonically_increasing_id().alias("row"),
    )


def placed(rows: DataFrame, by: str, order: list[str]) -> DataFrame:
    """``rows`` with ``i``, the place from 0 among those of the same ``by`` in ``order`` (unique together), and ``n``, how many there are.

    Rows are dealt by range and numbered inside their partition; what is added up are counts by partition and ``by``.
    """
    ranged = rows.repartitionByRange(by, *order).sortWithinPartitions(by, *order)
    ranged = staged(ranged.withColumn("place", F.monotonically_increasing_id()), "placed")
    task = F.shiftright("place", 33)
    counts = ranged.groupBy(task.alias("task"), by).agg(F.count("*").alias("own"), F.min("place").alias("first"))
    before = Window.partitionBy(by).orderBy("task")  # a row for each partition at most
    counts = counts.select("task", by, "first", F.coalesce(F.sum("own").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
                           F.sum("own").over(Window.partitionBy(by)).alias("n"))
    counts = staged(counts, "placed-counts")
    return ranged.withColumn("task", task).join(counts, ["task", by]).withColumn("i", F.col("place") - F.col("first") + F.col("before")).drop("task", "place", "first", "before")


def runs(nodes: DataFrame, fanout: int, *carried: str) -> DataFrame:
    """Nodes (part, i, n, h) to runs (part, i, n, kids): ``i`` and ``n`` are those of the parents, ``kids`` the children in order."""
    kid = F.struct(F.col("i").alias("at"), "h", *carried)
    return nodes.groupBy("part", F.expr(f"i div {fanout}").alias("i"), F.expr(f"(n + {fanout - 1}) div {fanout}").alias("n")).agg(F.array_sort(F.collect_list(kid)).alias("kids"))


def joined(kids: Column) -> Column:
    return F.aggregate(kids, F.lit(b""), lambda acc, k: F.concat(acc, k["h"]))


def parents(level: DataFrame) -> DataFrame:
    return level.select("part", "i", "n", digest(as_text(joined(F.col("kids")))).alias("h"))


def climbed(nodes: DataFrame, fanout: int, *carried: str) -> list[DataFrame]:
    """Levels of runs from the nodes up. A part of one node is left out: it is its own top."""
    levels, most = [], nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        level = staged(runs(nodes.where("n > 1"), fanout, *(carried if not levels else ())), "merkle-level")
        levels.append(level)
        nodes, most = parents(level), -(-most // fanout)
    return levels


def _descended(kid: Column, kids: Column, path: Column) -> Column:
    """The path of a child: the siblings before and after it, then its parent's path."""
    left, right = F.filter(kids, lambda k: k["at"] < kid["at"]), F.filter(kids, lambda k: k["at"] > kid["at"])
    return F.concat(F.array(F.struct(joined(left).alias("left"), joined(right).alias("right"))), path)


def proofs(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The children of the bottom runs (part, kid, path and what else ``tops`` has), by way of all levels from the top down; ``tops``: part, path of its top, others."""
    others = [c for c in tops.columns if c not in ("part", "path")]
    above = None
    for level in reversed(levels):
        down = level.where("n = 1").join(tops, "part").select("part", "kids", "path", *others)  # a part's last run
        if above is not None:
            held = level.where("n > 1").withColumnRenamed("i", "at").join(above, ["part", "at"])
            down = down.union(held.select("part", "kids", "path", *others))
        down = down.select("part", F.explode("kids").alias("kid"), "kids", "path", *others)
        down = down.select("part", "kid", _descended(F.col("kid"), F.col("kids"), F.col("path")).alias("path"), *others)
        above = down.select("part", F.col("kid.at").alias("at"), "path", *others)
    return down


def manifest(docs: DataFrame, fanout: int = FANOUT, tampered: int = TAMPERED) -> DataFrame:
    """One row per row of ``docs``: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Leaves ascend by doc_id within a language, null ids first; rows that share an id follow each other by their digests, and
    equal rows are interchangeable. A null language is a part of its own that comes first, an empty one another. A single leaf is its own
    subroot, a single subroot the root. An empty table gives an empty result; columns beside doc_id, source, lang, n_chars, text are ignored.
    """
    rows = staged(leaves(docs, tampered), "leaves")
    nodes = staged(placed(rows, "part", ["doc_id", "leaf", "row"]).select("part", "i", "n", F.col("leaf").alias("h"), "doc_id", "found"), "merkle-leaves")
    discard(rows)
    levels = climbed(nodes, fanout, "doc_id", "found")
    tops = nodes.where("n = 1").select("part", "h")
    for level in levels:
        tops = tops.union(parents(level.where("n = 1")).select("part", "h"))
    subroots = staged(tops, "subroots")
    # The same once more over the subroots, whose order is that of their parts.
    over = staged(placed(subroots.select(F.lit(0).alias("tree"), F.col("part").alias("name"), "h"), "tree", ["name"]).select(F.col("tree").alias("part"), "i", "n", "h", "name"), "merkle-subroots")
    upper = climbed(over, fanout, "name")
    empty = F.array().cast("array<struct<left:binary,right:binary>>")
    root = parents(upper[-1]).select("h") if upper else over.select("h")
    end = over.select("part").distinct().withColumn("path", empty)
    top = [F.col("root.h").alias("root")]
    ways = proofs(upper, end).select(F.col("kid.name").alias("part"), F.col("kid.h").alias("subroot"), "path") if upper else over.select(F.col("name").alias("part"), F.col("h").alias("subroot"), empty.alias("path"))
    ways = staged(ways.crossJoin(root.alias("root")).select("part", "subroot", "path", *top), "merkle-ways")  # the root is one row
    found = nodes.where("n = 1").join(ways, "part").select("doc_id", F.col("h").alias("leaf"), "found", "subroot", "root", "path")
    if levels:
        found = found.union(proofs(levels, ways).select("kid.doc_id", F.col("kid.h").alias("leaf"), "kid.found", "subroot", "root", "path"))
    siblings = F.aggregate("path", F.lit(b""), lambda acc, s: F.concat(acc, s["left"], s["right"]))
    folded = F.aggregate("path", F.coalesce("found", "leaf"), lambda acc, s: digest(as_text(F.concat(s["left"], acc, s["right"]))))
    return found.select("doc_id", "leaf", "subroot", "root", digest(as_text(siblings)).alias("proof"), folded.alias("folded")).select(
        "doc_id", *[as_text(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")], as_text(F.col("proof")).alias("proof_sha256"), as_text(F.col("folded")).alias("folded_root"),
        (F.col("folded") == F.col("root")).alias("verified"),
    )
