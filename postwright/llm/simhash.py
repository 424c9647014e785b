"""Near-duplicate groups by SimHash fingerprints.

Candidates come from a segment-popcount embedding: a 64-bit fingerprint becomes 32 counts,
the set bits of each two-bit segment. The Manhattan distance of two embeddings never exceeds
the Hamming distance of the fingerprints. The 32 axes form five groups, and every choice of
three groups spans a grid whose cells are the points' exact coordinates on those axes. A
Manhattan distance of two or less touches two groups at most, so such points share a cell on
at least one of the ten grids: the range join is ten equi-joins. Pairs in a cell are then
verified by Hamming distance. A cell yields a spanning forest of its links, not its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postwright.llm._common import only, small_batches, staged
from postwright.llm.components import connected_components, forest

SEED = 42
LOW = 0x5555555555555555
#: Axes (two-bit segments) of each group, as numbers of segments.
GROUP_SIZES = (6, 6, 6, 7, 7)
#: Cells with more fingerprints than this are linked by way of their one-bit neighbours.
HOT_CELL = 4096
#: Neighbours compared at once in short runs of a cell.
LAGS = 12
SHINGLES_AT_ONCE = 1 << 16


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def grid_masks() -> list[int]:
    """For each grid the bits of the segments on its axes, as signed 64-bit integers."""
    groups, at = [], 0
    for n in GROUP_SIZES:
        groups.append(((1 << 2 * n) - 1) << at)
        at += 2 * n
    keep = len(GROUP_SIZES) - 2
    return [signed(sum(c)) for c in combinations(groups, keep)]


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """SimHash of a text's word shingles: words after lower-casing A-Z, split at ASCII white space, repeats included.

    Fewer words than ``width`` make one shingle, no words (or null) the fingerprint zero.
    """
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    width = min(width, len(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - width + 1].tolist()
    ends = ends[width - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), SHINGLES_AT_ONCE):
        till = at + SHINGLES_AT_ONCE
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at:till], ends[at:till], strict=True)], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(starts), bitorder="little").tobytes(), "little")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [fingerprint(x) for x in b.column(1).to_pylist()]
        fps = pa.array(np.array(found, np.uint64).view(np.int64), pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0), fps], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit integer."""
    small_batches(docs.sparkSession)
    d = only(docs, doc_id=id_col, text=text_col)
    kind = d.schema["doc_id"].dataType.simpleString()
    return d.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(_fingerprints, f"doc_id {kind}, fp long")


def embedding(fp):
    """Set bits of each two-bit segment, in two bits each (no carry leaves a segment)."""
    low, high = fp.bitwiseAND(F.lit(LOW)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(LOW))
    return low.bitwiseXOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def _popcounts(x: np.ndarray) -> np.ndarray:
    low, high = x & np.uint64(LOW), (x >> np.uint64(1)) & np.uint64(LOW)
    return (low ^ high) | ((low & high) << np.uint64(1))


def manhattan(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Manhattan distance of two embeddings: per axis the counts 0, 1, 2 differ by a 2 only between 0 and 2."""
    d = _popcounts(x) ^ _popcounts(y)  # 01 or 11: the counts differ by one; 10: by two
    odd, high = d & np.uint64(LOW), (d >> np.uint64(1)) & np.uint64(LOW)
    return np.bitwise_count(odd) + 2 * np.bitwise_count(high & ~odd)


def near(x: np.ndarray, y: np.ndarray, radius: int) -> np.ndarray:
    """Where the lower bound and then the Hamming distance stay within ``radius``."""
    out = manhattan(x, y) <= radius
    out[out] = np.bitwise_count((x ^ y)[out]) <= radius
    return out


def _long_run(fp: np.ndarray, rep: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    found_i, found_j = [], []
    for at in range(0, len(fp), 256):
        block = fp[at : at + 256]
        hit = near(np.repeat(block, len(fp)), np.tile(fp, len(block)), radius).reshape(len(block), -1)
        i, j = np.nonzero(np.triu(hit, at + 1))
        local = forest(len(fp), i + at, j)
        moved = np.flatnonzero(local != np.arange(len(fp)))
        found_i.append(moved)
        found_j.append(local[moved])
    i, j = np.concatenate(found_i), np.concatenate(found_j)
    label = forest(len(fp), i, j)
    order = np.argsort(rep, kind="stable")
    least = np.full(len(fp), -1)
    least[label[order][::-1]] = order[::-1]  # the node with the smallest rep of each label
    moved = np.flatnonzero(least[label] != np.arange(len(fp)))
    return rep[moved], rep[least[label[moved]]]


def _link_cells(radius: int, hot: int):
    """Rows sorted by (grid, cell, fp) to links: kind 0 (a, b) between representatives, kind 1 members (fp, rep) of hot cells."""

    def out(kind, a, b):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["kind", "a", "b"])

    def whole_cells(key, fp, rep):
        for k in range(1, LAGS + 1):
            if k >= len(fp):
                break
            same = np.flatnonzero((key[k:] == key[:-k]).all(axis=1))
            ok = same[near(fp[same], fp[same + k], radius)]
            if len(ok):
                yield out(0, rep[ok], rep[ok + k])
        first = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]).any(axis=1))))
        for a, b in zip(first, np.append(first[1:], len(fp)), strict=True):
            if b - a > hot:
                yield out(1, fp[a:b].view(np.int64), rep[a:b])
            elif b - a > LAGS + 1:
                i, j = _long_run(fp[a:b], rep[a:b], radius)
                if len(i):
                    yield out(0, i, j)

    def run(batches):
        held, n_hot = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            key = np.column_stack([b.column(0).to_numpy().astype(np.int64), b.column(1).to_numpy()])
            fp, rep = b.column(2).to_numpy().view(np.uint64), b.column(3).to_numpy()
            if held:
                key, fp, rep = (np.concatenate(x) for x in zip(held[0], (key, fp, rep), strict=True))
            last = int(np.argmax((key == key[-1]).all(axis=1)))  # start of the last, perhaps unfinished, cell
            if last:
                end = 0
                if n_hot:  # a hot cell ends here: its last rows are members like those before
                    end = int(np.argmin((key == key[0]).all(axis=1)))
                    yield out(1, fp[:end].view(np.int64), rep[:end])
                    n_hot = 0
                if end < last:
                    yield from whole_cells(key[end:last], fp[end:last], rep[end:last])
            key, fp, rep = key[last:], fp[last:], rep[last:]
            if len(fp) > hot or n_hot:  # members of a hot cell pass through: memory stays bounded
                yield out(1, fp[:-1].view(np.int64), rep[:-1])
                n_hot += len(fp) - 1
                key, fp, rep = key[-1:], fp[-1:], rep[-1:]
            held = [(key, fp, rep)]
        if held:
            key, fp, rep = held[0]
            yield out(1, fp.view(np.int64), rep) if n_hot else out(0, rep[:0], rep[:0])
            if not n_hot:
                yield from whole_cells(key, fp, rep)

    return run


def near_links(unique: DataFrame, radius: int = 2, hot: int = HOT_CELL) -> DataFrame:
    """Links (a, b) that connect exactly the fingerprints within ``radius`` (2 at most) of each other.

    ``unique`` has one row per fingerprint: fp and rep (an integer that names it).
    """
    if not 0 <= radius <= 2:
        raise ValueError("the grids are made for a radius of 2 or less")
    cells = F.explode(F.array(*[
        F.struct(F.lit(g).alias("grid"), F.col("emb").bitwiseAND(F.lit(m)).alias("cell")) for g, m in enumerate(grid_masks())
    ])).alias("c")
    points = (
        unique.select("fp", "rep", embedding(F.col("fp")).alias("emb"))
        .select("fp", "rep", cells)
        .select(F.col("c.grid").alias("grid"), F.col("c.cell").alias("cell"), "fp", "rep")
    )
    found = staged(
        points.repartition("grid", "cell").sortWithinPartitions("grid", "cell", "fp")
        .mapInArrow(_link_cells(radius, hot), "kind int, a long, b long"),
        "simhash-links",
    )
    links = found.where("kind = 0").select("a", "b").distinct()
    members = found.where("kind = 1").select(F.col("a").alias("fp"), F.col("b").alias("rep")).distinct()
    if members.isEmpty():
        return links
    # Two fingerprints lie within two bits of each other just when both lie within one bit of some midpoint,
    # and within one bit when they agree with one bit position cleared.
    if radius == 2:
        variants = [F.col("fp").bitwiseXOR(F.lit(x)) for x in [0, *(signed(1 << k) for k in range(64))]]
        near_points = members.select("rep", F.explode(F.array(*variants)).alias("mid"))
    else:
        variants = [F.col("fp").bitwiseAND(F.lit(~signed(1 << k))) for k in range(64 * radius)]
        near_points = members.select("rep", F.posexplode(F.array(*variants, F.col("fp"))).alias("bit", "mid"))
    keys = [c for c in near_points.columns if c != "rep"]
    least = near_points.groupBy(*keys).agg(F.min("rep").alias("least"), F.count("*").alias("n")).where("n > 1")
    hot_links = near_points.join(least, keys).where("rep <> least").select(F.col("rep").alias("a"), F.col("least").alias("b"))
    return links.union(hot_links.distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2, hot: int = HOT_CELL) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    Documents whose fingerprints differ in ``radius`` bits or fewer are linked; component_id is the
    smallest doc_id reachable. Texts without words (empty, null) have fingerprint zero and link
    like any other. Rows with a null doc_id get a fingerprint and a null component, and link nothing.
    Repeated rows share a component; an empty table gives an empty result; other columns are ignored.
    """
    prints = staged(fingerprints(docs, id_col, text_col), "fingerprints")
    unique = staged(prints.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min(F.col("doc_id").cast("long")).alias("rep")), "unique-prints")
    member = connected_components(near_links(unique, radius, hot))
    classes = unique.join(member, unique.rep == member.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return prints.join(classes, "fp", "left").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
    )

