"""SimHash near-dedup at a stated similarity: one document of each group of similarity 0.8 or more.

Similarity is that of the sets of five-word shingles (the shared ones' part of all). Candidates come
from two sides and all are verified by their texts' shingles. The first side is the SimHash join
itself (``simhash.near_links`` on fingerprints of five-word shingles, by segment counts and grids), which
finds copies that differ in a few words. Fingerprints of texts of similarity 0.8 lie 9.7 of 64 bits apart on average,
where no grid of segment counts is selective, so the second side covers the rest: 32 bands of five MinHash
values, taken from 80. A pair of similarity 0.8 shares no band with a chance of 0.00004, one of 0.85 with less
than 0.00001. Before a pair's texts are compared, two things rule it out: a parity map of 512 bits, in which two sets differ in no
more bits than they differ in shingles (exact: what it rules out is not similar), and, for long texts, whose maps are
full, a sketch: a pair of which more than 31 MinHash values differ is not verified (that is four standard deviations from 0.8).

In each cell of candidates the pivots are compared with all members that are not yet connected
to them and then leave, until no cell holds two components: no pair of a cell goes unseen but for such that
cannot be similar, and a large group of near copies costs about one comparison a member. In a family of sets just below the
threshold many pairs meet, but those whose maps differ too much become no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postwright.llm._common import BROADCAST_IDS, discard, only, sent_or_shuffled, small_batches, staged, without_rows
from postwright.llm.components import connected_components
from postwright.llm.decontaminate import MULTIPLIER, WordHashes, shingle_hashes
from postwright.llm.simhash import near_links

WIDTH = 5
SIMILARITY = 0.8
HASHES = 80
BAND_ROWS = 5
#: Pivots of a cell in each round after the first two.
SLOTS = 128
#: Members that one task compares with a pivot.
SHARE = 256
AT_ONCE = 512
_DRAW = np.random.default_rng(42)
FLIPS = _DRAW.integers(0, 1 << 63, (HASHES, 1), dtype=np.uint64)
FACTORS = _DRAW.integers(0, 1 << 63, (HASHES, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Which MinHash values make a band: two orders of all, each cut into bands.
BANDS = np.concatenate([_DRAW.permutation(HASHES).reshape(-1, BAND_ROWS) for _ in range(2)])
#: Four bits of each MinHash value make a sketch of five longs.
SKETCH = HASHES // 16
LOW = 0x1111111111111111
#: Bits of a parity map, which stands behind the sketch in the same list.
PARITY = 512


def shingles(text: bytes | None, words: WordHashes, width: int = WIDTH) -> np.ndarray:
    """Distinct shingle hashes, sorted. Words as in ``simhash.fingerprint``; fewer than ``width`` make one shingle, none no shingle."""
    found = (text or b"").lower().split()
    return np.unique(shingle_hashes(words(found), min(width, len(found)))) if found else np.zeros(0, np.uint64)


def least_hashes(own: np.ndarray) -> np.ndarray:
    """The MinHash values of a set of shingles."""
    least = np.full(HASHES, ~np.uint64(0))
    for at in range(0, len(own), AT_ONCE):
        mixed = (own[None, at : at + AT_ONCE] ^ FLIPS) * FACTORS
        np.minimum(least, (mixed ^ (mixed >> np.uint64(32))).min(axis=1), out=least)
    return least


def bands(least: np.ndarray) -> np.ndarray:
    """The cell of each band: a hash of its number and its MinHash values."""
    h = np.arange(1, len(BANDS) + 1, dtype=np.uint64)
    for k in range(BAND_ROWS):
        h = (h ^ least[BANDS[:, k]]) * MULTIPLIER
        h ^= h >> np.uint64(29)
    return h


def sketch(least: np.ndarray) -> np.ndarray:
    """Four mixed bits of each MinHash value, sixteen to a long."""
    nibbles = (least * MULTIPLIER) >> np.uint64(60)
    return (nibbles.reshape(SKETCH, 16) << np.arange(0, 64, 4, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def parity(own: np.ndarray) -> np.ndarray:
    """Of each of ``PARITY`` buckets of shingles whether it holds an odd number of them, 64 to a long: a shingle that only one of two sets has changes one bit."""
    odd = np.bincount(((own * MULTIPLIER) >> np.uint64(32)).astype(np.int64) % PARITY, minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")


def set_fingerprint(own: np.ndarray) -> int:
    """SimHash of a set of shingle hashes."""
    ones = np.unpackbits(own.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(own), bitorder="little").tobytes(), "little", signed=True)


def differing(x: str, y: str) -> Column:
    """How many of two sketches' MinHash values differ (one in sixteen that does goes unseen)."""
    total = F.lit(0)
    for k in range(SKETCH):
        d = F.col(x)[k].bitwiseXOR(F.col(y)[k])
        d = d.bitwiseOR(F.shiftright(d, 1))
        d = d.bitwiseOR(F.shiftright(d, 2)).bitwiseAND(F.lit(LOW))
        total = total + F.bit_count(d)
    return total


def apart(x: str, y: str) -> Column:
    """In how many bits two parity maps differ: no more than the shingles that only one of the sets has."""
    total = F.lit(0)
    for k in range(SKETCH, SKETCH + PARITY // 64):
        total = total + F.bit_count(F.col(x)[k].bitwiseXOR(F.col(y)[k]))
    return total


def most_apart(least: float, x: str, y: str) -> Column:
    """The shingles that only one of two similar sets of these sizes has, at most: (all - d) / (all + d) >= least."""
    return (F.col(x) + F.col(y)) * ((1 - least) / (1 + least)) + 1e-6


def similarity(x: np.ndarray, y: np.ndarray) -> float:
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return shared / max(1, len(x) + len(y) - shared)


def _sign(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        longs = pa.list_(pa.int64())
        for b in batches:
            keys, sizes, prints, cells, sketches = [], [], [], [], []
            for t in b.column(2).to_pylist():
                own = shingles(t, words, width)
                keys.append(xxhash.xxh3_64_intdigest(own.tobytes()))
                sizes.append(len(own))
                if len(own):
                    least = least_hashes(own)
                    prints.append(set_fingerprint(own))
                    cells.append(bands(least).view(np.int64))
                    sketches.append(np.concatenate([sketch(least), parity(own)]).view(np.int64))
                else:
                    prints.append(None)
                    cells.append([])
                    sketches.append([])
            columns = [pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(prints, pa.int64()), pa.array(cells, longs), pa.array(sketches, longs)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], names=["doc_id", "text_hash", "key", "size", "fp", "cells", "sketch"])

    return run


def _verify(width: int, least: float):
    """Rows (pivot, salt, member, text), a pivot's own row (without member) before its members', to the links among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pivot, own = WordHashes(), None, None
        for b in batches:
            found = []
            for p, m, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if m is None:
                    pivot, own = p, shingles(text, words, width)
                elif p == pivot and similarity(own, shingles(text, words, width)) >= least:
                    found.append((p, m))
            a, b = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _verified(pairs: DataFrame, texts: DataFrame, width: int, least: float) -> DataFrame:
    """Those pairs (a, b) whose texts are similar. Each pair moves one text, each pivot a; a pivot of many is dealt to several tasks."""
    shares = pairs.groupBy("a").agg(F.ceil(F.count("*") / SHARE).cast("int").alias("shares"))
    members = (
        pairs.join(shares, "a").select(F.col("a").alias("pivot"), F.pmod(F.xxhash64("b"), F.col("shares")).cast("int").alias("salt"), F.col("b").alias("key"))
        .join(texts.select("key", "text"), "key").select("pivot", "salt", F.col("key").alias("member"), "text")
    )
    pivots = (
        shares.select(F.col("a").alias("key"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("salt"))
        .join(texts.select("key", "text"), "key").select(F.col("key").alias("pivot"), "salt", F.lit(None).cast("long").alias("member"), "text")
    )
    both = pivots.union(members).repartition("pivot", "salt").sortWithinPartitions("pivot", "salt", F.col("member").asc_nulls_first())
    return both.mapInArrow(_verify(width, least), "a long, b long")


def _shingle_rows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = shingles(text, words, width)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), key, np.int64)), pa.array(own.view(np.int64))], names=["key", "shingle"])

    return run


def _alone(keys: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """(key, alone): how many shingles of each text no other of these texts has."""
    rows = texts.join(keys, "key", "left_semi").select("key", "text").mapInArrow(_shingle_rows(width), "key long, shingle long")
    return rows.groupBy("shingle").agg(F.min("key").alias("key"), F.count("*").alias("n")).where("n = 1").groupBy("key").agg(F.count("*").alias("alone"))


def _room(least: float, size: str = "size", alone: str = "alone") -> Column:
    """The largest set that can be similar to one of this size, ``alone`` of whose shingles no other set has: they share size - alone at most."""
    return F.col(size) / least - F.col(alone) * (1 + least) / least + 1e-6


def _links(members: DataFrame, close: DataFrame, texts: DataFrame, width: int, least: float) -> DataFrame | None:
    """(node, component) of the similar pairs among the members of each cell and in ``close`` (a, b); None where there are none.

    ``members``: cell, key, size, central, sketch, cells. The first two rounds compare a cell's most central member (whose cells are the
    largest: in a group of copies the one with the fewest edits, so that it is similar to the most others) with all. Later rounds take
    those that are still outside its component. Members that have too many shingles of their own to be similar to any other of
    the cell leave; that bound is exact.
    """
    most = int(HASHES * (1 - least) + 4 * (HASHES * least * (1 - least)) ** 0.5) + 1  # MinHash values that may differ at this similarity
    near = (F.col("room") >= F.col("p_size")) & (F.col("p_room") >= F.col("size"))
    near = near & (apart("sketch", "p_sketch") <= most_apart(least, "size", "p_size")) & (differing("sketch", "p_sketch") <= most)
    once = F.col("cell") == F.array_min(F.array_intersect("cells", "p_cells"))  # a pair of several cells is compared in one
    alive = members.withColumns({"component": F.col("key"), "alone": F.lit(0)})
    member, round_no = None, 0
    first = F.struct((-F.col("central")).alias("c"), "key", "component")
    while True:
        pivot = F.min(F.struct((-F.col("central")).alias("c"), "key", "component", "size", "alone", "sketch", "cells")).alias("p")
        if round_no < 2:
            pivots = alive.groupBy("cell").agg(pivot)
        else:
            mains = alive.groupBy("cell").agg(F.min(first).alias("m")).select("cell", F.col("m.component").alias("main"))
            pivots = alive.join(mains, "cell").where("component <> main").groupBy("cell", F.pmod("key", F.lit(SLOTS)).alias("slot")).agg(pivot)
        pivots = pivots.select("cell", F.col("p.key").alias("pivot"), F.col("p.component").alias("of"), F.col("p.size").alias("p_size"), F.col("p.alone").alias("p_alone"), F.col("p.sketch").alias("p_sketch"), F.col("p.cells").alias("p_cells"))
        pivots = staged(pivots.withColumn("p_room", _room(least, "p_size", "p_alone")), "pivots")
        met = alive.withColumn("room", _room(least)).join(pivots, "cell").where((F.col("component") != F.col("of")) & near & once)
        pairs = met.select(F.least("key", "pivot").alias("a"), F.greatest("key", "pivot").alias("b"))
        pairs = staged((pairs if round_no else pairs.union(close)).distinct(), "near-pairs")
        found = staged(_verified(pairs, texts, width, least), "near-links")
        if not found.isEmpty():
            links = found if member is None else found.union(member.select(F.col("node").alias("a"), F.col("component").alias("b")))
            member = staged(connected_components(links), "near-components")
        left = alive.join(pivots.select("cell", F.col("pivot").alias("key")), ["cell", "key"], "left_anti")
        if member is not None:
            left = left.drop("component").join(member.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
        was = alive
        if round_no == 1:
            left = staged(_mixed(left), "near-left")
            own = _alone(left.select("key").distinct(), texts, width)
            left = left.drop("alone").join(own, "key", "left").withColumn("alone", F.coalesce(F.col("alone").cast("int"), F.lit(0)))
        if round_no:  # what is too different from all others of its cell leaves, and then the cells of one component
            smallest = left.groupBy("cell").agg(F.min("size").alias("smallest"))
            left = left.join(smallest, "cell").where(_room(least) >= F.col("smallest")).drop("smallest")
        alive = staged(_mixed(left), "near-alive")
        for old in (pivots, pairs, found, was):
            discard(old)
        if alive.isEmpty():
            return member
        round_no += 1


def _mixed(alive: DataFrame) -> DataFrame:
    """The members of cells that hold more than one component."""
    mixed = alive.groupBy("cell").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("cell")
    return alive.join(mixed, "cell").select("cell", "key", "size", "central", "sketch", "cells", "component", "alone")


def _members(unique: DataFrame) -> DataFrame:
    """(cell, key, central, size, sketch, cells) of the sets in cells of more than one; ``central``: the sizes of a set's cells, added up.

    A set is joined once and dealt to its cells after that: a row a set moves with all that the set carries, not a row a cell.
    """
    points = unique.select("key", F.explode("cells").alias("cell"))
    shared = points.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1")
    own = points.join(shared, "cell").groupBy("key").agg(F.sum("n").alias("central"), F.collect_list("cell").alias("own"))
    return own.join(unique.select("key", "size", "sketch", "cells"), "key").select(F.explode("own").alias("cell"), "key", "central", "size", "sketch", "cells")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, least: float = SIMILARITY) -> DataFrame:
    """``docs`` with one document of each group that pairs of similarity ``least`` or more connect, the one with the smallest id; every column stays.

    Texts without words (null, empty) are copies of each other. Null ids come last, ties go to the smaller
    text hash; rows that share id and text stay or go together. Rows are dropped by id and text, so a repeated id costs no other text.
    An empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    d = only(docs, doc_id=id_col, text=text_col).select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))
    kind = d.schema["doc_id"].dataType.simpleString()
    prints = staged(d.mapInArrow(_sign(width), f"doc_id {kind}, text_hash long, key long, size int, fp long, cells array<long>, sketch array<long>"), "shingle-prints")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    unique = staged(
        prints.groupBy("key").agg(F.min(order).alias("first"), F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("size", "fp", "cells", "sketch")]),
        "shingle-sets",
    )
    members = staged(_members(unique), "near-members")
    # The SimHash side: fingerprints, each named by one of its sets, and the other sets that have it.
    named = staged(unique.where("fp IS NOT NULL").groupBy("fp").agg(F.min("key").alias("rep")), "near-prints")
    close = staged(
        near_links(named).union(unique.join(named, "fp").where("key <> rep").select(F.col("key").alias("a"), F.col("rep").alias("b")))
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
        "near-close",
    )
    wanted = members.select("key").union(close.select("a")).union(close.select("b")).distinct()
    wanted = unique.join(wanted, "key", "left_semi").select("key", F.col("first.doc_id").alias("id"), F.col("first.text_hash").alias("hash"))
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash"))
    texts = staged(d.join(sent_or_shuffled(wanted, "near-wanted", BROADCAST_IDS // 2), same).select("key", "text").dropDuplicates(["key"]), "near-texts")
    member = _links(members, close, texts, width, least)
    # Only sets of several rows or with a similar set have rows to drop.
    if member is None:
        keeps = unique.where("n > 1").select("key", F.col("first").alias("keep"))
    else:
        linked = staged(unique.join(member.withColumnRenamed("node", "key"), "key", "left").where("n > 1 OR component IS NOT NULL")
                        .select("key", "first", F.coalesce("component", "key").alias("component")), "near-linked")
        keeps = linked.join(linked.groupBy("component").agg(F.min("first").alias("keep")), "component").select("key", "keep")
    dropped = prints.join(staged(keeps, "near-keeps"), "key").where(~(F.col("doc_id").eqNullSafe(F.col("keep.doc_id")) & (F.col("text_hash") == F.col("keep.text_hash"))))
    return without_rows(docs, id_col, text_col, dropped.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")))
