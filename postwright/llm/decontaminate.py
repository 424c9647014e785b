"""Benchmark decontamination: find documents that hold a passage of a benchmark item.

For an item of n words every window of n words of a document is a suspect, and a document of fewer
words is one as a whole. Windows too few of whose shingles belong to the benchmark at all cannot be similar to any item of
their size and are passed over, which loses nothing. All others get a SimHash of their shingles, repeats included, rolled along the
document. A multi-index over the items' fingerprints, and nothing else, says which items a window may
be: the 64 bits are cut into six blocks, and a block that differs in two bits or fewer is looked up among the
items' blocks. Two fingerprints within 17 bits have such a block, as six blocks with three or more differing bits
each make 18. Candidates within 17 bits are verified by exact weighted-shingle
similarity: the sum of least over the sum of largest shingle counts, 0.8 or more.

At a similarity of 0.8 the fingerprints of window and item differ in 9.2 of 64 bits on
average, with a standard deviation of 2.8; the radius of 17 is 2.8 of those away, so that about one window in 400 at that very
similarity is missed (the tests measure it), and fewer above it. Of random fingerprints a fifth share
a block and one in 7,000 lies within the radius.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from postwright.llm._common import only, small_batches

WIDTH = 5
SIMILARITY = 0.8
RADIUS = 17
#: Bits in which a block that is looked up may differ.
TOLERANCE = 2
#: Windows that are fingerprinted at once.
SPAN = 8192
#: Bytes of benchmark text that may be broadcast at once; a larger benchmark is searched in blocks of items.
BLOCK_BYTES = 8 << 20
#: Bits of the table that says which shingle hashes may belong to the benchmark.
TABLE_BITS = 22

#: Words are runs of digits, letters and non-ASCII bytes after lower-casing A-Z.
WORDS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)  # 2**64 divided by the golden ratio


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(WORDS).split()


class WordHashes:
    """64-bit hashes of words, remembered up to a bound."""

    def __init__(self, most: int = 200_000):
        self.known: dict[bytes, int] = {}
        self.most = most

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        found = list(map(known.get, words))
        if None in found:
            for k, h in enumerate(found):
                if h is None:
                    h = known.get(words[k])
                    if h is None:
                        h = xxhash.xxh64_intdigest(words[k])
                        if len(known) < self.most and len(words[k]) <= 64:
                            known[words[k]] = h
                    found[k] = h
        return np.array(found, np.uint64)


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of every ``width`` consecutive words, from the words' hashes."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h = (h ^ words[k : k + n]) * MULTIPLIER
        h ^= h >> np.uint64(29)
    return h


def simhash(hashes: np.ndarray, counts: np.ndarray) -> np.uint64:
    """A bit is set where the shingles that have it weigh more than half."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = counts @ bits.astype(np.int64)
    return np.packbits(ones * 2 > counts.sum(), bitorder="little").view("<u8")[0]


def blocks_of(bits: int, n: int) -> list[tuple[int, int]]:
    """(shift, mask) of n blocks that share out the bits."""
    cuts = [bits * k // n for k in range(n + 1)]
    return [(a, (1 << (b - a)) - 1) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


class Item:
    __slots__ = ("counts", "fp", "item_id", "n_shingles", "n_words", "width", "words")

    def __init__(self, item_id, words: list[bytes], hashes: np.ndarray):
        self.item_id, self.n_words = item_id, len(words)
        self.width = min(WIDTH, len(words))
        shingles = shingle_hashes(hashes, self.width)
        self.n_shingles = len(shingles)
        self.words = words
        self.counts = Counter(tuple(words[k : k + self.width]) for k in range(self.n_shingles))
        h, n = np.unique(shingles, return_counts=True)
        self.fp = simhash(h, n)


class MultiIndex:
    """Fingerprints by blocks of bits: all that lie within ``radius`` of a given one, by looking up blocks that differ in few bits."""

    def __init__(self, fps: np.ndarray, radius: int, tolerance: int = TOLERANCE):
        self.fps, self.radius = fps, radius
        t = min(tolerance, radius)
        self.blocks = blocks_of(64, -(-(radius + 1) // (t + 1)))
        self.tables = []
        for shift, mask in self.blocks:
            bits = [np.uint64(1) << np.uint64(k) for k in range(int(mask).bit_length())]
            flips = np.array([sum(c, np.uint64(0)) for k in range(t + 1) for c in combinations(bits, k)], np.uint64)
            keys = (((fps >> np.uint64(shift)) & np.uint64(mask))[:, None] ^ flips).ravel()
            order = np.argsort(keys, kind="stable")
            known, start = np.unique(keys[order], return_index=True)
            self.tables.append((known, np.append(start, len(keys)), order // len(flips)))

    def near(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``fps``, place in the index) of all pairs within the radius."""
        found = [np.zeros(0, np.int64)]
        for (shift, mask), (known, start, items) in zip(self.blocks, self.tables, strict=True):
            keys = (fps >> np.uint64(shift)) & np.uint64(mask)
            at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
            hit = np.flatnonzero(known[at] == keys)
            first, n = start[at[hit]], start[at[hit] + 1] - start[at[hit]]
            place = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
            found.append(np.repeat(hit, n) * len(self.fps) + items[place])
        w, k = np.divmod(np.unique(np.concatenate(found)), len(self.fps))
        close = np.bitwise_count(fps[w] ^ self.fps[k]) <= self.radius
        return w[close], k[close]


def rolled(own: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Fingerprints of the windows of ``size`` shingles from each of ``starts`` (ascending) on."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        low = starts[at]
        till = int(np.searchsorted(starts, low + SPAN))
        bits = np.unpackbits(own[low : starts[till - 1] + size].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sums = np.concatenate((np.zeros((1, 64), np.int32), np.cumsum(bits, axis=0, dtype=np.int32)))
        ones = sums[starts[at:till] - low + size] - sums[starts[at:till] - low]
        out[at:till] = np.packbits(ones * 2 > size, axis=1, bitorder="little").view("<u8").ravel()
        at = till
    return out


class Benchmark:
    """The items of one block, by number of shingles; items without words match nothing."""

    def __init__(self, items: list[tuple[object, bytes | None]], similarity: float = SIMILARITY, radius: int = RADIUS):
        self.similarity, self.hash = similarity, WordHashes()
        self.items = [Item(i, w, self.hash(w)) for i, t in items if (w := words_of(t))]
        groups: dict[tuple[int, int], list[Item]] = {}
        known: dict[int, list[np.ndarray]] = {}
        for it in self.items:
            groups.setdefault((it.width, it.n_shingles), []).append(it)
            known.setdefault(it.width, []).append(shingle_hashes(self.hash(it.words), it.width))
        self.groups = {k: (own, MultiIndex(np.array([it.fp for it in own], np.uint64), radius)) for k, own in groups.items()}
        self.tables = {}
        for width, found in known.items():
            hashes = np.unique(np.concatenate(found))
            maybe = np.zeros(1 << TABLE_BITS, bool)
            maybe[hashes >> np.uint64(64 - TABLE_BITS)] = True
            self.tables[width] = (maybe, hashes)

    def search(self, text: bytes | None) -> list[tuple[object, int, int, float]]:
        """(item_id, first word, words, similarity): the best window of each item that the text holds, the first among equals."""
        words = words_of(text)
        if not words or not self.items:
            return []
        hashed = self.hash(words)
        found = []
        for width, (maybe, known) in self.tables.items():
            own = shingle_hashes(hashed, width)
            at = np.flatnonzero(maybe[own >> np.uint64(64 - TABLE_BITS)])
            if len(at):
                at = at[known[np.minimum(np.searchsorted(known, own[at]), len(known) - 1)] == own[at]]
            if len(at):
                found += self._windows(words, own, at, width)
        return sorted(found, key=lambda x: (x[0] is None, x[0], x[1]))

    def _windows(self, words, own, at, width):
        hits = np.zeros(len(own) + 1, np.int64)
        hits[at + 1] = 1
        before = np.cumsum(hits)  # benchmark shingles ahead of each place
        out = []
        for (w, n), (items, index) in self.groups.items():
            size = min(n, len(own))  # a document shorter than the item is one window
            # A similarity of s needs s / (1 + s) of the shingles of item and window together.
            need = int(np.ceil((n + size) * self.similarity / (1 + self.similarity) - 1e-9))
            if w != width or len(at) < need:
                continue
            low, high = max(0, int(at[0]) - size + 1), min(len(own) - size, int(at[-1]))
            inside = before[low + size : high + size + 1] - before[low : high + 1]
            starts = np.flatnonzero(inside >= need) + low
            if not len(starts):
                continue
            place, item = index.near(rolled(own, starts, size))
            most = inside[starts[place] - low]  # shingles that the window can share with any item
            for k in np.unique(item).tolist():
                mine = np.flatnonzero(item == k)
                best = self._best(items[k], words, starts[place[mine]], most[mine] / (n + size - most[mine]), size)
                if best:
                    out.append((items[k].item_id, best[1], size + width - 1, best[0]))
        return out

    def _best(self, it, words, starts, bounds, size):
        """(similarity, start) of the most similar window, the first among equals; those that may be most similar are compared first."""
        best = None
        for j in np.lexsort((starts, -bounds)).tolist():
            s, bound = int(starts[j]), float(bounds[j])
            if bound < self.similarity - 1e-9 or best and (bound, -s) < (best[0], -best[1]):
                break
            sim = weighted_similarity(it.counts, Counter(tuple(words[q : q + it.width]) for q in range(s, s + size)))
            if sim >= self.similarity and (best is None or (sim, -s) > (best[0], -best[1])):
                best = (sim, s)
        return best


def weighted_similarity(a: Counter, b: Counter) -> float:
    return (a & b).total() / (a | b).total()


def _search(items, similarity: float, radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = Benchmark(items.value, similarity, radius)
        for b in batches:
            row, found = [], []
            for k, text in enumerate(b.column(1).to_pylist()):
                hits = bench.search(text)
                row += [k] * len(hits)
                found += hits
            col = list(zip(*found, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row, pa.int64())), pa.array(list(col[0]), pa.int64()), pa.array(list(col[1]), pa.int64()), pa.array(list(col[2]), pa.int64()), pa.array(list(col[3]), pa.float64())],
                names=["doc_id", "item_id", "start_word", "n_words", "similarity"],
            )

    return run


def benchmark_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[int, bytes]]]:
    """Items in blocks of at most ``block_bytes`` of text each (a longer item is a block of its own)."""
    block, size = [], 0
    rows = only(benchmark, item_id=id_col, text=text_col).where("item_id IS NOT NULL AND text IS NOT NULL")
    for r in rows.select(F.col("item_id").cast("long"), F.col("text").cast("binary").alias("text")).orderBy("item_id").toLocalIterator():
        if block and size + len(r.text) > block_bytes:
            yield block
            block, size = [], 0
        block.append((r.item_id, bytes(r.text)))
        size += len(r.text)
    if block:
        yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS, id_col: str = "doc_id",
                 text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each document and item found in it: doc_id, item_id, start_word, n_words, similarity.

    Items of fewer than five words are one shingle each. Null or wordless texts, on either side,
    match nothing; items with a null id are left out; repeated documents each give their rows, and
    repeated items one each. Other columns are ignored; an empty table on either side gives an empty result.
    The benchmark is the query set: it is sent to executors in blocks of bounded size, each of which
    costs one pass over the documents.
    """
    spark = docs.sparkSession
    small_batches(spark)
    d = only(docs, doc_id=id_col, text=text_col).select("doc_id", F.col("text").cast("binary").alias("text"))
    kind = d.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id long, start_word long, n_words long, similarity double"
    found = None
    for block in benchmark_blocks(benchmark, item_id_col, item_text_col, block_bytes):
        part = d.mapInArrow(_search(spark.sparkContext.broadcast(block), similarity, radius), schema)
        found = part if found is None else found.union(part)
    return spark.createDataFrame([], schema) if found is None else found


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS, text_col: str = "text",
                      item_id_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without those that hold a benchmark item; every column stays. Each row is judged where it is: no shuffle."""
    spark = docs.sparkSession
    small_batches(spark)
    for block in benchmark_blocks(benchmark, item_id_col, item_text_col, block_bytes):
        docs = docs.where(_clean(spark.sparkContext.broadcast(block), similarity, radius)(F.col(f"`{text_col}`").cast("binary")))
    return docs


def _clean(items, similarity: float, radius: int):
    @F.pandas_udf(BooleanType())
    def clean(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bench = Benchmark(items.value, similarity, radius)
        for t in texts:
            yield t.map(lambda x: not bench.search(x)).astype(bool)

    return clean
