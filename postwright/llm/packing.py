"""Best-fit packing of tokenised documents into sequences, with certified bin counts.

Pieces are dealt to partitions by hash. Each partition packs its own by best-fit decreasing
and computes lower bounds by dual feasible functions: a partition whose bin count equals its
bound is certified and closed. In partitions with a gap, full bins are closed too and
the rest of the documents are exchanged: dealt anew over fewer partitions, which rerun
best-fit decreasing. A rerun that does not save a bin keeps the bins it was given; exchanges
go on until one saves nothing, or all that is open has been in one partition.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postwright.llm._common import discard, only, small_batches, staged
from postwright.llm.tokenize import default_path, encoder

CAPACITY = 2048
#: Pieces that one task packs; a task holds about 60 bytes for each.
PARTITION_PIECES = 60_000


def _pieces(path: str, end_id: int, capacity: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(path), np.array([end_id], "<u4")
        for b in batches:
            doc, piece, start, length, crc, raw = [], [], [], [], [], []
            for k, text in enumerate(b.column(1).to_pylist()):
                ids = np.concatenate([enc.encode(text), end])
                for n, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity].tobytes()
                    doc.append(k)
                    piece.append(n)
                    start.append(at)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    raw.append(part)
            columns = [b.column(0).take(pa.array(doc, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                columns.append(pa.array(raw, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def token_pieces(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0,
                 capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): each document's ids and then ``end_id``, cut at every ``capacity`` ids.

    Null text is empty: one piece of the end id alone. Whole texts are encoded whatever their length.
    """
    small_batches(docs.sparkSession)
    d = only(docs, doc_id=id_col, text=text_col)
    schema = f"doc_id {d.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    return d.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_pieces(tokenizer or default_path(), end_id, capacity, keep_ids), schema)


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs: the best of the volume bound and two families of dual feasible functions.

    ``counts[s]`` is the number of pieces of size s. For each threshold t up to half the capacity:
    sizes over capacity - t round up to it and those under t down to 0; and the classic
    staircase floor((k + 1) * size / capacity), which counts size whole where it divides evenly.
    """
    sizes = np.arange(capacity + 1)
    best = -(-int((counts * sizes).sum()) // capacity)
    number = np.concatenate((np.cumsum(counts[::-1])[::-1], [0]))  # pieces of at least this size
    volume = np.concatenate((np.cumsum((counts * sizes)[::-1])[::-1], [0]))
    t = np.arange(capacity // 2 + 1)
    large = number[capacity - t + 1]
    middle = volume[t] - volume[capacity - t + 1]
    best = max(best, int((large + -(-middle // capacity)).max()))
    half = int(number[capacity // 2 + 1])
    best = max(best, half)
    for k in range(1, 41):
        steps = (k + 1) * sizes
        value = np.where(steps % capacity == 0, sizes * k, steps // capacity * capacity)  # in units of 1 / (k * capacity)
        best = max(best, -(-int((counts * value).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Bin number of each piece: longest first, each into the fullest bin that has room."""
    bins = np.empty(len(lengths), np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # open bins by the room left
    mask = 0  # bit r: some bin has room r
    used = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = mask >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                mask &= ~(1 << r)
        else:
            r, b = capacity, used
            used += 1
        bins[i] = b
        if r > n:
            room[r - n].append(b)
            mask |= 1 << (r - n)
    return bins


def pack_one(lengths: np.ndarray, given: np.ndarray | None, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(bin of each piece, whether the piece's bin is closed, lower bound) of one partition.

    ``given``: the bins that the pieces are in now, kept where packing anew saves none.
    """
    bins = best_fit_decreasing(lengths, capacity)
    if given is not None:
        now = np.unique(given, return_inverse=True)[1]
        if now.max() <= bins.max():
            bins = now
    bound = lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
    filled = np.bincount(bins, lengths)
    closed = np.full(len(bins), True) if bins.max() + 1 == bound else filled[bins] == capacity
    return bins, closed, bound


def _packer(capacity: int, n_parts: int, round_no: int):
    """Rows (part, uid, length, bin) of whole parts to (uid, length, bin, closed); bins are numbered uniquely by round and part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [b for b in batches if b.num_rows]
        if not found:
            return
        t = pa.Table.from_batches(found)
        part, uid, length, given = (t.column(k).to_numpy() for k in range(4))
        order = np.argsort(part, kind="stable")
        cuts = np.flatnonzero(np.diff(part[order])) + 1
        for rows in np.split(order, cuts):
            rows = rows[np.argsort(uid[rows], kind="stable")]  # the same packing whatever order rows come in
            bins, closed, _ = pack_one(length[rows], given[rows] if round_no else None, capacity)
            base = (int(part[rows[0]]) + n_parts * round_no) << 32
            yield pa.RecordBatch.from_arrays(
                [pa.array(uid[rows]), pa.array(length[rows]), pa.array(bins + base, pa.int64()), pa.array(closed)], names=["uid", "length", "bin", "closed"]
            )

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, partition_pieces: int = PARTITION_PIECES, exchanges: int | None = None) -> DataFrame:
    """(uid, sequence_id, offset) for pieces (uid long, length long), lengths 1 to ``capacity``.

    sequence_id is any number, offset the piece's place in its sequence, gapless from 0.
    Pieces as long as a sequence have one of their own and take no part in packing. ``exchanges``: at most so many, where given.
    """
    spark = pieces.sparkSession
    whole = pieces.where(F.col("length") >= capacity).select("uid", "length", (-F.col("uid") - 1).alias("bin"))
    rest = pieces.where(F.col("length") < capacity).select("uid", "length", F.lit(0).cast("long").alias("bin"))
    n_all = rest.count()
    open_rows, closed_parts, n_parts = rest, [], max(1, -(-n_all // partition_pieces))
    first = n_parts
    k = given = 0
    while n := open_rows.count() if k else n_all:
        n_parts = max(1, -(-n // partition_pieces))
        # After the first round whole bins move, so that what they hold can be kept.
        key = F.col("bin") if k else F.col("uid")
        dealt = open_rows.select(F.pmod(F.xxhash64(key, F.lit(k)), F.lit(n_parts)).alias("part"), "uid", "length", "bin")
        done = staged(dealt.repartitionByRange(n_parts, "part").mapInArrow(_packer(capacity, max(first, n_parts), k), "uid long, length long, bin long, closed boolean"), f"packed-{k}")
        last = k == exchanges or k and (n_parts == 1 or done.select("bin").distinct().count() >= given)
        if last:
            closed_parts.append(done.select("uid", "length", "bin"))
            break
        closed_parts.append(done.where("closed").select("uid", "length", "bin"))
        open_rows = done.where("NOT closed").select("uid", "length", "bin")
        given, k = open_rows.select("bin").distinct().count(), k + 1
    packed = whole
    for p in closed_parts:
        packed = packed.union(p)
    from pyspark.sql import Window

    w = Window.partitionBy("bin").orderBy("uid").rowsBetween(Window.unboundedPreceding, -1)  # a bin holds capacity pieces at most
    return packed.select("uid", F.col("bin").alias("sequence_id"), F.coalesce(F.sum("length").over(w), F.lit(0)).cast("long").alias("offset"))


def packed_pieces(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0,
                  capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Every piece of every document with its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids].

    Null and empty texts are one piece of the end id. Null doc_ids are kept. Repeated rows are packed
    each on its own. Only documents longer than ``capacity`` are cut. An empty table gives an empty result.
    """
    pieces = staged(token_pieces(docs, tokenizer, id_col, text_col, end_id, capacity, keep_ids).withColumn("uid", F.monotonically_increasing_id()), "pieces")
    placed = pack(pieces.select("uid", "length"), capacity)
    out = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if keep_ids else [])]
    return pieces.join(placed, "uid").select(*out)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids): the packed sequences themselves, from ``packed_pieces(keep_ids=True)``; ids are 32-bit little-endian."""
    return packed.groupBy("sequence_id").agg(
        F.sum("length").alias("n_tokens"),
        F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"),  # at most one sequence's ids
    ).select("sequence_id", "n_tokens", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
