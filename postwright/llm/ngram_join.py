"""Jaccard join of word n-gram sets by a token-group matrix, exact at its threshold.

Documents become sets of hashed shingles (tokens); equal sets are one. The matrix says which tokens the members of a group of
similar sets have between them. As no member can share more of its tokens with a query than the group's union does, a group is
opened only where the union holds enough of the query's tokens, and its members are then compared exactly.

1. Most sets are like no other. A part of the token universe, chosen by hash, shows which: a set with more tokens that no other
   set has than a partner could lack is left out. That loses nothing, and moves a quarter of a long set's tokens.
2. Groups of near copies: for each of eight MinHash values the most central set of those that share it is a group of one,
   against which the others are compared. What that links is one component, and is not compared again.
3. The other sets, and all across components: tokens of one component only cannot link two, so each set is looked up by as few
   of its rarest other tokens as a partner must share one of (prefixes: ``need`` by the larger set, ``least_common`` by the smaller).
   Sets are dealt to groups of about 64 of like size in one component or under one MinHash value. The matrix (token, group, sizes)
   is joined with itself, so that two groups that may hold partners meet; then each set of one is a query to the other, for the bound and the comparison.

Every number of rounds is fixed. A group has a bounded number of sets and tokens (a longer set alone is one), a hot group's queries
are dealt to several tasks, and a large component of near copies costs eight comparisons a member, not its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postwright.llm._common import BROADCAST_IDS, only, sent_or_shuffled, small_batches, staged
from postwright.llm.components import connected_components

WIDTH = 4
#: Sets link when 100 * shared >= PERCENT * all.
PERCENT = 85
#: Part of the tokens that is looked at first, by the size of the set.
PARTS = ((64, 1.0), (400, 0.5), (1 << 62, 0.25))
HASHES = 8
#: Sets and tokens of a group, about.
GROUP = 64
GROUP_TOKENS = 1 << 17
#: Queries of a group that one task takes.
SHARE = 128
#: Bytes of text hashed at once.
SPAN = 1 << 20
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)  # 2**64 divided by the golden ratio

_DRAW = np.random.default_rng(13)
FLIPS = _DRAW.integers(0, 1 << 63, (HASHES, 1), dtype=np.uint64)
FACTORS = _DRAW.integers(0, 1 << 63, (HASHES, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: A random number for each byte, the same for A-Z and a-z.
BYTES = _DRAW.integers(1, 1 << 63, 256, dtype=np.uint64)
BYTES[0x41:0x5B] = BYTES[0x61:0x7B]
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
BASE = 0xD1342543DE82EF95
UNBASE = pow(BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[:1] = 1
    return np.cumprod(steps)


class WordHashes:
    """Hashes of the words of a text: a word's bytes as digits of a number modulo 2**64, mixed. Whole arrays at once, ``SPAN`` bytes at a time."""

    def __init__(self, span: int = SPAN):
        self.span = span
        self.up, self.down = _powers(BASE, span + 1), _powers(UNBASE, span + 1)

    def __call__(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(hash, first byte) of each word."""
        data = np.frombuffer(text, np.uint8)
        gap = np.ones(len(data) + 2, bool)
        gap[1:-1] = SPACE[data]
        edges = np.flatnonzero(gap[1:] != gap[:-1])
        starts, ends = edges[::2], edges[1::2]
        out = np.empty(len(starts), np.uint64)
        at = 0
        while at < len(starts):
            low = starts[at]
            till = int(np.searchsorted(ends, low + self.span, side="right"))
            if till == at:  # a word longer than a span
                out[at] = xxhash.xxh64_intdigest(text[low : ends[at]].lower())
                at += 1
                continue
            sums = np.zeros(ends[till - 1] - low + 1, np.uint64)
            np.cumsum(BYTES[data[low : ends[till - 1]]] * self.up[: len(sums) - 1], out=sums[1:])
            a, b = starts[at:till] - low, ends[at:till] - low
            out[at:till] = mixed((sums[b] - sums[a]) * self.down[a])
            at = till
        return out, starts


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MULTIPLIER
    return h ^ (h >> np.uint64(29))


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    h = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for k in range(width):
        h = mixed(h ^ words[k : k + len(h)])
    return h


def token_sets(texts: list[bytes], words: WordHashes, width: int = WIDTH) -> Iterator[np.ndarray]:
    """The set of each text, sorted: words after lower-casing A-Z, split at ASCII white space; fewer than ``width`` words make one token, none an empty set."""
    at = 0
    while at < len(texts):
        till, size = at, 0
        while till < len(texts) and (till == at or size + len(texts[till]) < SPAN):
            size += len(texts[till]) + 1
            till += 1
        own = texts[at:till]
        hashed, starts = words(b" ".join(own))
        grams = shingle_hashes(hashed, width)
        first = np.searchsorted(starts, np.concatenate(([0], np.cumsum([len(t) + 1 for t in own]))))
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            yield np.unique(grams[a : b - width + 1] if b - a >= width else shingle_hashes(hashed[a:b], b - a) if b > a else grams[:0])
        at = till


def part_of(size: int) -> float:
    return next(part for most, part in PARTS if size < most)


def first_tokens(own: np.ndarray, part: float) -> int:
    """How many of a sorted set lie in the first ``part`` of the universe."""
    return len(own) if part == 1 else int(np.searchsorted(own, np.uint64(int(part * 2**64))))


def least_hashes(own: np.ndarray) -> np.ndarray:
    least = np.full(HASHES, ~np.uint64(0))
    for at in range(0, len(own), 4096):
        np.minimum(least, mixed((own[None, at : at + 4096] ^ FLIPS) * FACTORS).min(axis=1), out=least)
    return least


def need(percent: int = PERCENT) -> Column:
    """The tokens that a set (of ``size``) shares with any partner, at least."""
    return F.expr(f"cast((size * {percent} + 99) div 100 as int)")


def lists(rows: list[np.ndarray]) -> pa.Array:
    """An Arrow list of 64-bit integers for each of ``rows``."""
    ends = np.cumsum([0, *map(len, rows)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.uint64), *rows]).view(np.int64)))


def _sign(width: int, percent: int):
    """(doc_id, text hash, text) to the set's key, size and first tokens; ``counted`` of these are looked at, the rest is for larger sets to see."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for b in batches:
            keys, sizes, counted, first = [], [], [], []
            for own in token_sets(b.column(2).to_pylist(), words, width):
                keys.append(xxhash.xxh3_64_intdigest(own.tobytes()))
                sizes.append(len(own))
                counted.append(first_tokens(own, part_of(len(own))))
                first.append(own[: first_tokens(own, part_of(len(own) * percent // 100))])
            columns = [pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(counted, pa.int32()), lists(first)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], names=["doc_id", "text_hash", "key", "size", "counted", "first"])

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for b in batches:
            found = list(token_sets(b.column(0).to_pylist(), words, width))
            keys = np.array([xxhash.xxh3_64_intdigest(own.tobytes()) for own in found], np.uint64).view(np.int64)
            columns = [pa.array(keys), pa.array(list(map(len, found)), pa.int32()), lists([least_hashes(own) for own in found]), lists(found)]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "size", "least", "tokens"])

    return run


class Group:
    """Sets of one group and the union of their tokens, with whom each token belongs to."""

    def __init__(self, keys: list[int], components: list[int], sets: list[np.ndarray]):
        self.keys, self.components, self.sizes = np.array(keys), np.array(components), np.array(list(map(len, sets)))
        held, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(held, kind="stable")
        self.owner = owner[order]
        self.union, self.first = np.unique(held[order], return_index=True)
        self.first = np.append(self.first, len(held))

    def partners(self, own: np.ndarray, component: int, percent: int) -> np.ndarray:
        """Keys of the members that are similar to the query and of another component; none is looked at unless the union has enough of the query's tokens."""
        at = np.minimum(np.searchsorted(self.union, own), len(self.union) - 1)
        at = at[self.union[at] == own]
        if 100 * len(at) < percent * len(own):
            return self.keys[:0]
        first, n = self.first[at], self.first[at + 1] - self.first[at]
        place = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
        shared = np.bincount(self.owner[place], minlength=len(self.keys))
        similar = 100 * shared >= percent * (self.sizes + len(own) - shared)
        return self.keys[similar & (self.components != component)]


def _compare(percent: int):
    """Rows (group, salt, is_query, key, component, tokens), a group's members before its queries, to links (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, members, group = None, [], None
        for b in batches:
            ends, tokens = b.column(5).offsets.to_numpy(), b.column(5).values.to_numpy().view(np.uint64)
            links_a, links_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for k, (gid, salt, query, key, component) in enumerate(zip(*[b.column(c).to_pylist() for c in range(5)], strict=True)):
                own = tokens[ends[k] : ends[k + 1]]
                if here != (gid, salt):
                    here, members, group = (gid, salt), [], None
                if not query:
                    members.append((key, component, own.copy()))
                    continue
                if group is None:
                    group = Group(*map(list, zip(*members, strict=True)))
                found = group.partners(own, component, percent)
                links_a.append(np.full(len(found), key))
                links_b.append(found)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (links_a, links_b)], names=["a", "b"])

    return run


def opened(members: DataFrame, queries: DataFrame, sets: DataFrame, percent: int = PERCENT, share: int = SHARE) -> DataFrame:
    """Links (a, b) from queries (gid, key) to those ``members`` (gid, key) of the same group that are similar; ``sets``: key, component, tokens.

    A query's tokens move once a group, a group's once for each ``share`` of its queries.
    """
    shares = staged(queries.groupBy("gid").agg(F.ceil(F.count("*") / share).cast("int").alias("shares")), "group-shares")
    asked = queries.join(shares, "gid").select("gid", F.pmod(F.xxhash64("key"), F.col("shares")).cast("int").alias("salt"), F.lit(True).alias("is_query"), "key")
    held = members.join(shares, "gid").select("gid", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("salt"), F.lit(False).alias("is_query"), "key")
    rows = held.union(asked).join(sets.select("key", "component", "tokens"), "key").select("gid", "salt", "is_query", "key", "component", "tokens")
    return rows.repartition("gid", "salt").sortWithinPartitions("gid", "salt", "is_query", "key").mapInArrow(_compare(percent), "a long, b long")


def _similar_sizes(x: str, y: str, percent: int) -> Column:
    return (F.col(x) * 100 >= F.col(y) * percent) & (F.col(y) * 100 >= F.col(x) * percent)


def may_link(prints: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(key, id, hash) of the sets that may have a partner, each with one row that has it: step 1."""
    sets = prints.where("doc_id IS NOT NULL AND size > 0")
    tokens = sets.select("key", "counted", F.posexplode("first").alias("at", "token")).select("key", "token", (F.col("at") < F.col("counted")).alias("looked_at"))
    alone = tokens.groupBy("token").agg(F.min("key").alias("key"), F.max("key").alias("last"), F.max("looked_at").alias("looked_at")).where("key = last AND looked_at")
    alone = alone.groupBy("key").agg(F.count("*").alias("alone"))
    unique = sets.groupBy("key", "size").agg(F.min(F.struct("doc_id", "text_hash")).alias("row"))
    left = unique.join(alone, "key", "left").where(F.coalesce("alone", F.lit(0)) <= F.col("size") - need(percent))
    return left.select("key", F.col("row.doc_id").alias("id"), F.col("row.text_hash").alias("hash"))


def near_copies(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links (a, b) of step 2: each set with the most central set of each MinHash value, where they are similar."""
    cells = staged(sets.select("key", "size", F.posexplode("least").alias("k", "cell")), "ngram-cells")
    crowd = staged(cells.groupBy("k", "cell").agg(F.count("*").alias("n")).where("n > 1"), "ngram-crowds")
    cells = cells.join(crowd, ["k", "cell"])
    central = staged(cells.groupBy("key").agg(F.sum("n").alias("central")), "ngram-central")
    cells = staged(cells.drop("n").join(central, "key"), "ngram-cells")
    first = staged(cells.groupBy("k", "cell").agg(F.min(F.struct((-F.col("central")).alias("c"), "key", "size")).alias("m")), "ngram-leaders")
    first = first.select("k", "cell", F.col("m.key").alias("gid"), F.col("m.size").alias("other"))
    pairs = cells.join(first, ["k", "cell"]).where((F.col("key") != F.col("gid")) & _similar_sizes("size", "other", percent))
    pairs = staged(pairs.select("gid", "key").distinct(), "ngram-pairs")
    leaders = pairs.select("gid").distinct().select("gid", F.col("gid").alias("key"))
    return opened(leaders, pairs, sets.withColumn("component", F.col("key")), percent)


def prefixes(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(key, size, component, cell, token, held): the tokens by which a set finds its partners in other components, and whether it is also found by them: step 3."""
    tokens = sets.select("component", F.explode("tokens").alias("token"))
    known = tokens.groupBy("token").agg(F.count("*").alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("token", "n")
    own = sets.select("key", "size", "component", "cell", F.explode("tokens").alias("token")).join(staged(known, "ngram-tokens"), "token")
    w = Window.partitionBy("key")  # the tokens of one set
    ranked = own.withColumns({"rank": F.row_number().over(w.orderBy("n", "token")), "alone": F.col("size") - F.count("*").over(w)})
    place = F.col("rank") + F.col("alone")
    least_common = F.expr(f"cast((size * {2 * percent} + {99 + percent}) div {100 + percent} as int)")
    return (
        ranked.where(place <= F.col("size") - need(percent) + 1)
        .select("key", "size", "component", "cell", "token", (place <= F.col("size") - least_common + 1).alias("held"))
    )


def matrix_links(sets: DataFrame, percent: int = PERCENT, group: int = GROUP) -> DataFrame:
    """Links (a, b) of step 3, from the larger set to the smaller; ``sets``: key, size, component, cell, tokens."""
    found = staged(prefixes(sets, percent), "ngram-prefixes")
    about = F.xxhash64("cell", F.floor(F.log2("size") * 4)).alias("about")
    keys = staged(found.select("key", "size", "cell").distinct().select("key", "size", about), "ngram-keys")
    blocks = staged(keys.groupBy("about").agg(F.ceil(F.greatest(F.count("*") / group, F.sum("size") / GROUP_TOKENS)).alias("blocks")), "ngram-blocks")
    groups = staged(keys.join(blocks, "about").select("key", F.xxhash64("about", F.pmod(F.xxhash64("key"), F.col("blocks"))).alias("gid")), "ngram-groups")
    matrix = found.join(groups, "key").groupBy("token", "gid").agg(*[f(c).alias(f"{n}_{c}") for c in ("size", "component") for n, f in (("lo", F.min), ("hi", F.max))], F.max("held").alias("held"))
    matrix = staged(matrix, "token-group-matrix")
    # Groups ask for each other, not set by set: a token that a whole family has makes a row for two groups, whatever they hold.
    asks = matrix.select("token", *[F.col(c).alias(f"q_{c}") for c in matrix.columns if c not in ("token", "held")])
    alike = (F.col("lo_component") == F.col("hi_component")) & (F.col("q_lo_component") == F.col("q_hi_component")) & (F.col("lo_component") == F.col("q_lo_component"))
    fits = (F.col("lo_size") <= F.col("q_hi_size")) & (F.col("hi_size") * 100 >= F.col("q_lo_size") * percent) & ~alike
    pairs = asks.join(matrix.where("held").drop("held"), "token").where(fits).select(F.least("gid", "q_gid").alias("gid"), F.greatest("gid", "q_gid").alias("q_gid")).distinct()
    asked = staged(staged(pairs, "ngram-pairs").join(groups.withColumnRenamed("gid", "q_gid"), "q_gid").select("gid", "key"), "ngram-queries")
    return opened(groups, asked, sets, percent)


def joined(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(prints, links): each row's set (doc_id, text_hash, key, size), and links (a, b) of keys that connect just the sets that ``percent`` connects."""
    spark = docs.sparkSession
    small_batches(spark)
    d = only(docs, doc_id=id_col, text=text_col).select("doc_id", F.xxhash64("text").alias("text_hash"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    kind = d.schema["doc_id"].dataType.simpleString()
    prints = staged(d.mapInArrow(_sign(width, percent), f"doc_id {kind}, text_hash long, key long, size int, counted int, first array<long>"), "ngram-prints")
    wanted = may_link(prints, percent).select("id", "hash")
    row = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash"))
    sets = staged(d.join(sent_or_shuffled(wanted, "ngram-wanted", BROADCAST_IDS // 2), row).select("text").mapInArrow(_sets(width), "key long, size int, least array<long>, tokens array<long>"), "ngram-sets")
    if sets.count() > sets.select("key").distinct().count():  # rows that share id and text
        sets = staged(sets.dropDuplicates(["key"]), "ngram-sets")
    links = staged(near_copies(sets, percent), "ngram-links")
    member = sent_or_shuffled(connected_components(links), "ngram-components")
    own = F.coalesce("component", "key")
    labelled = sets.join(member.withColumnRenamed("node", "key"), "key", "left")
    labelled = staged(labelled.select("key", "size", own.alias("component"), F.coalesce("component", F.col("least")[0]).alias("cell"), "tokens"), "ngram-labelled")
    return prints, staged(links.union(matrix_links(labelled, percent)), "ngram-links")


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id.

    Documents link when their sets of ``width``-word shingles share ``percent`` of all in either, or more; component_id is the smallest
    doc_id reachable. Equal sets link. A text without words (null, empty) has an empty set and is its own component. Rows with a null
    doc_id get a count and a null component, and link nothing. Repeated rows share a component; an empty table gives an empty result; other columns are ignored.
    """
    prints, links = joined(docs, id_col, text_col, width, percent)
    unique = staged(prints.where("doc_id IS NOT NULL AND size > 0").groupBy("key").agg(F.min("doc_id").alias("rep")), "ngram-unique")
    member = staged(connected_components(links), "ngram-components")
    least = unique.join(member, unique.key == member.node).groupBy("component").agg(F.min("rep").alias("least"))
    linked = member.join(least, "component").select(F.col("node").alias("key"), "least")
    classes = staged(unique.join(linked, "key", "left").select("key", F.coalesce("least", "rep").alias("component_id")), "ngram-classes")
    rows = prints.select("doc_id", "size", F.when(F.col("size") > 0, F.col("key")).alias("key"))
    return rows.join(classes, "key", "left").select(
        "doc_id", F.col("size").cast("long").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("doc_id"))).alias("component_id"),
    )
