"""Token ids in binary files: fixed-width bit packing with block offsets.

A shard holds consecutive documents. Layout, all integers little-endian:

    magic "PWTOK1\\0\\0" | u32 bits | u32 block_ids | u64 n_docs | u64 n_ids | u64 n_blocks
    doc_end   u64[n_docs]     ids of the shard up to and with each document
    blocks    u64[n_blocks]   byte offset of each block in the payload
    payload                   ids, ``bits`` each, lowest bit first; each block starts on a byte

``bits`` is the least number that holds the largest id of the vocabulary. Any range of ids is
read by seeking to its first block; a block unpacks in a few numpy operations.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postwright.llm._common import only, shared_path, small_batches
from postwright.llm.tokenize import default_path, encoder
from postwright.operators.ordering import prefix_sums

MAGIC = b"PWTOK1\0\0"
HEADER = np.dtype([("magic", "S8"), ("bits", "<u4"), ("block_ids", "<u4"), ("n_docs", "<u8"), ("n_ids", "<u8"), ("n_blocks", "<u8")])
BLOCK_IDS = 4096
#: A shard is closed once it holds this many ids (packed ids in memory: 2 bytes each for a 16-bit vocabulary).
SHARD_IDS = 8_000_000
#: Tasks that read shards, at most; each then reads several.
READERS = 20_000


def bits_for(vocab_size: int) -> int:
    return max(1, int(vocab_size - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """Ids as ``bits`` bits each, lowest first, padded to a whole byte."""
    ids = np.ascontiguousarray(ids, "<u4")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    each = np.unpackbits(ids.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(each.ravel(), bitorder="little").tobytes()


def unpack_bits(raw: bytes, bits: int, n: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(raw, f"<u{bits // 8}", n).astype("<u4")
    each = np.unpackbits(np.frombuffer(raw, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    whole = np.zeros((n, 32), np.uint8)
    whole[:, :bits] = each
    return np.packbits(whole, axis=1, bitorder="little").view("<u4").ravel()


class ShardWriter:
    """Gathers documents' ids and writes one shard; ids are packed block by block as they come."""

    def __init__(self, bits: int, block_ids: int = BLOCK_IDS):
        self.bits, self.block_ids = bits, block_ids
        self.doc_end: list[int] = []
        self.blocks: list[bytes] = []
        self.rest = np.zeros(0, "<u4")
        self.n_ids = 0

    def add(self, ids: np.ndarray) -> None:
        self.n_ids += len(ids)
        self.doc_end.append(self.n_ids)
        self.rest = np.concatenate([self.rest, ids])
        whole = len(self.rest) // self.block_ids * self.block_ids
        for at in range(0, whole, self.block_ids):
            self.blocks.append(pack_bits(self.rest[at : at + self.block_ids], self.bits))
        self.rest = self.rest[whole:]

    def write(self, files: fs.FileSystem, path: str) -> None:
        """To another name and then in place, so that a file under its name is whole whichever attempt wrote it."""
        blocks = self.blocks + ([pack_bits(self.rest, self.bits)] if len(self.rest) else [])
        offsets = np.concatenate(([0], np.cumsum([len(b) for b in blocks], dtype="<u8")))[: len(blocks)].astype("<u8")
        head = np.array([(MAGIC, self.bits, self.block_ids, len(self.doc_end), self.n_ids, len(blocks))], HEADER)
        files.create_dir(path.rpartition("/")[0], recursive=True)
        with files.open_output_stream(temp := f"{path}.{uuid.uuid4().hex}.tmp") as out:
            out.write(head.tobytes())
            out.write(np.array(self.doc_end, "<u8").tobytes())
            out.write(offsets.tobytes())
            for b in blocks:
                out.write(b)
        files.move(temp, path)


class ShardReader:
    """Random access to a shard's ids and documents."""

    def __init__(self, uri: str):
        files, path = open_uri(uri)
        self.file = files.open_input_file(path)
        head = np.frombuffer(self.file.read(HEADER.itemsize), HEADER)[0]
        if head["magic"].ljust(8, b"\0") != MAGIC:
            raise ValueError(f"{uri} is not a token shard")
        self.bits, self.block_ids, self.n_docs, self.n_ids, n_blocks = (int(head[k]) for k in ("bits", "block_ids", "n_docs", "n_ids", "n_blocks"))
        self.doc_end = np.frombuffer(self.file.read(8 * self.n_docs), "<u8").astype(np.int64)
        self.blocks = np.frombuffer(self.file.read(8 * n_blocks), "<u8").astype(np.int64)
        self.payload = HEADER.itemsize + 8 * self.n_docs + 8 * n_blocks

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids number ``start`` to ``stop`` of the shard; reads just the blocks that hold them."""
        start, stop = max(0, start), min(stop, self.n_ids)
        if stop <= start:
            return np.zeros(0, "<u4")
        first, last = start // self.block_ids, (stop - 1) // self.block_ids
        n = min(self.n_ids, (last + 1) * self.block_ids) - first * self.block_ids
        end = self.blocks[last] + -(-min(self.block_ids, self.n_ids - last * self.block_ids) * self.bits // 8)
        self.file.seek(self.payload + int(self.blocks[first]))
        raw = self.file.read(int(end - self.blocks[first]))
        if self.block_ids * self.bits % 8 == 0:  # whole blocks lie end to end in bits too
            found = unpack_bits(raw, self.bits, n)
        else:
            cuts = [*(self.blocks[first : last + 1] - self.blocks[first]).tolist(), len(raw)]
            sizes = [self.block_ids] * (last - first) + [n - (last - first) * self.block_ids]
            found = np.concatenate([unpack_bits(raw[a:b], self.bits, k) for a, b, k in zip(cuts[:-1], cuts[1:], sizes, strict=True)])
        return found[start - first * self.block_ids : stop - first * self.block_ids]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.doc_end[k - 1]) if k else 0, int(self.doc_end[k]))

    def documents(self, at_once: int = 1 << 20) -> Iterator[np.ndarray]:
        """All documents in order; about ``at_once`` ids are in memory."""
        k = 0
        while k < self.n_docs:
            start = int(self.doc_end[k - 1]) if k else 0
            till = max(k + 1, int(np.searchsorted(self.doc_end, start + at_once, "right")))
            ids = self.ids(start, int(self.doc_end[till - 1]))
            yield from np.split(ids, self.doc_end[k : till - 1] - start)
            k = till


def open_uri(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if ":" in uri.split("/")[0] else f"file://{uri}")


def _write(tokenizer: str, end_id: int, folder: str, bits: int, block_ids: int, shard_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, end = encoder(tokenizer), np.array([end_id], "<u4")
        files, path = open_uri(folder)
        part = TaskContext.get().partitionId()
        n_shards, shard, docs = 0, ShardWriter(bits, block_ids), []

        def close():
            nonlocal n_shards, shard, docs
            name = f"part-{part:06d}-{n_shards:06d}.tok"
            shard.write(files, f"{path}/{name}")
            row = [[f"{folder}/{name}"], [part], [n_shards], [shard.n_ids], [pa.concat_arrays(docs)]]
            out = pa.RecordBatch.from_arrays(
                [pa.array(row[0]), pa.array(row[1], pa.int32()), pa.array(row[2], pa.int32()), pa.array(row[3], pa.int64()), pa.ListArray.from_arrays([0, len(row[4][0])], row[4][0])],
                names=["path", "part", "shard", "n_ids", "doc_ids"],
            )
            n_shards, shard, docs = n_shards + 1, ShardWriter(bits, block_ids), []
            return out

        for b in batches:
            first = 0
            for k, text in enumerate(b.column(1).to_pylist()):
                shard.add(np.concatenate([enc.encode(text), end]))
                if shard.n_ids >= shard_ids:
                    docs.append(b.column(0).slice(first, k + 1 - first))
                    first = k + 1
                    yield close()
            if b.num_rows > first:
                docs.append(b.column(0).slice(first))
        if shard.doc_end:
            yield close()

    return run


def write_token_files(docs: DataFrame, folder: str, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text",
                      end_id: int = 1, block_ids: int = BLOCK_IDS, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encode whole texts, append ``end_id`` and write shards in ascending id order into ``folder``, which all executors share.

    Returns the manifest, one row per shard: path, part, shard, n_ids, doc_ids, base (ids in all shards before).
    Null text is empty (the end id alone); null ids come first; rows of one id are ordered by a hash of the text and then the text, so
    that many rows of one id, or without one, are dealt to many tasks.
    A task that runs again writes the same names, each file appearing whole.
    """
    spark = docs.sparkSession
    small_batches(spark)
    path = tokenizer or default_path()
    bits = bits_for(max(encoder(path).vocab_size, end_id + 1))
    d = only(docs, doc_id=id_col, text=text_col).select("doc_id", F.col("text").cast("string").alias("text"))
    kind = d.schema["doc_id"].dataType.simpleString()
    order = [F.col("doc_id").asc_nulls_first(), F.col("text_hash")]
    shards = (
        d.withColumn("text_hash", F.xxhash64("text")).repartitionByRange(*order).sortWithinPartitions(*order, "text").select("doc_id", "text")
        .mapInArrow(_write(path, end_id, folder, bits, block_ids, shard_ids), f"path string, part int, shard int, n_ids long, doc_ids array<{kind}>")
    )
    manifest = f"{folder}/manifest"
    shards.write.parquet(manifest)
    shards = spark.read.schema(shards.schema).parquet(manifest)
    bases = prefix_sums(shards.select("path", "part", "shard", "n_ids"), ["part", "shard"], {"base": F.col("n_ids")})
    return shards.join(bases.select("path", F.col("base").cast("long").alias("base")), "path")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(b.num_rows):
            reader, start = ShardReader(b.column(0)[k].as_py()), b.column(1)[k].as_py()
            ids = b.column(2)[k].values
            size = np.diff(reader.doc_end, prepend=0)
            crc = [zlib.crc32(x.tobytes()) for x in reader.documents()]
            begin = start + reader.doc_end - size
            for at in range(0, len(ids), 10_000):
                part = slice(at, at + 10_000)
                yield pa.RecordBatch.from_arrays([ids.slice(at, 10_000), pa.array(begin[part]), pa.array(size[part]), pa.array(crc[part], pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_token_files(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files of a manifest.

    A manifest is small beside its files, so the number of tasks follows the files: one for each, up to ``READERS``.
    """
    tasks = max(1, min(manifest.count(), READERS))
    kind = manifest.schema["doc_ids"].dataType.elementType.simpleString()
    return manifest.select("path", "base", "doc_ids").repartition(tasks).mapInArrow(_read, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1) -> DataFrame:
    """Write token files into the shared folder and read them back: one row per row of ``docs``.

    Other columns are ignored; repeated rows are documents of their own; an empty table gives an empty result.
    """
    folder = shared_path(docs.sparkSession, "tokens")
    return read_token_files(write_token_files(docs, folder, tokenizer, id_col, text_col, end_id))
