"""Files of known layout in a folder that executors share: fixed-stride postings and texts by offset.

Row i lies in file i // ``rows``, at a place that i alone gives, so the rows of a file can be written by any task and any row can be read without
its neighbours: k rows cost k reads (texts two each). A file appears under its name when it is whole, and the settings last of all; a run that broke off is
written over. Rows that were never written read as empty.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postwright.sources.log import open_uri

#: Rows of a file: of postings, of texts.
POSTING_ROWS, TEXT_ROWS = 1 << 16, 1 << 12


def _settings(folder: str) -> dict:
    files, path = open_uri(folder)
    with files.open_input_file(f"{path}/settings.json") as f:
        return json.loads(f.read())


def _written(table: DataFrame, folder: str, rows: int, settings: dict, pack: Callable[[pa.Table, int], bytes]) -> None:
    """Write files of ``rows`` rows of a table (row_id, ...); a group of the shuffle is a file, which is bounded."""

    def write(t: pa.Table) -> pa.Table:
        number = t.column("file")[0].as_py()
        ids = t.column("row_id").to_numpy()
        if len(np.unique(ids)) < len(ids):
            raise ValueError(f"a row stands twice in file {number}")
        raw = pack(t, number * rows)
        files, path = open_uri(folder)
        part = f"{path}/part-{number}-{uuid.uuid4().hex}"
        with files.open_output_stream(part) as out:
            out.write(raw)
        files.move(part, f"{path}/{number:012d}.bin")
        return pa.table({"file": pa.array([number], pa.int64()), "n": pa.array([len(ids)], pa.int64()), "last": pa.array([int(ids.max())], pa.int64())})

    files, path = open_uri(folder)
    files.create_dir(path, recursive=True)
    made = table.where("row_id >= 0").withColumn("file", F.expr(f"row_id div {rows}")).groupBy("file").applyInArrow(write, "file long, n long, last long")
    found = made.agg(F.sum("n").alias("n"), F.max("last").alias("last")).first()
    with files.open_output_stream(f"{path}/settings.json") as out:
        out.write(json.dumps({**settings, "rows": rows, "n": found.n or 0, "end": 0 if found["last"] is None else found["last"] + 1}).encode())


def _read(wanted: DataFrame, folder: str, rows: int, schema: str, read: Callable[[fs.FileSystem, str, np.ndarray], pa.Table]) -> DataFrame:
    """Rows of ``wanted`` (row_id, repeats and all), each file opened once by the task that has its rows."""

    def take(t: pa.Table) -> pa.Table:
        files, path = open_uri(folder)
        ids = t.column("row_id").to_numpy()
        return read(files, f"{path}/{t.column('file')[0].as_py():012d}.bin", ids)

    return wanted.select(F.col("row_id").cast("long").alias("row_id")).withColumn("file", F.expr(f"row_id div {rows}")).groupBy("file").applyInArrow(take, schema)


def _there(files: fs.FileSystem, path: str) -> bool:
    return files.get_file_info(path).type == fs.FileType.File


# --- postings ---


def write_postings(padded: DataFrame, folder: str, cap: int, rows: int = POSTING_ROWS) -> None:
    """A store of (row_id, idx, val), arrays of at most ``cap`` entries, as ``cap`` 32-bit numbers and ``cap`` 64-bit weights a row, padded with -1 and 0. A negative or null row_id is left out, one that stands twice is an error."""

    def pack(t: pa.Table, first: int) -> bytes:
        idx, val = np.full((rows, cap), -1, "<i4"), np.zeros((rows, cap), "<f8")
        for r, i, v in zip((t.column("row_id").to_numpy() - first).tolist(), t.column("idx").to_pylist(), t.column("val").to_pylist(), strict=True):
            idx[r, : len(i)], val[r, : len(v)] = i, v
        return np.concatenate([idx.view(np.uint8), val.view(np.uint8)], axis=1).tobytes()

    _written(padded.select("row_id", "idx", "val"), folder, rows, {"cap": cap}, pack)


POSTINGS = "row_id long, idx array<int>, val array<double>"


def _postings(ids: np.ndarray, raw: np.ndarray, cap: int) -> pa.Table:
    idx, val = np.ascontiguousarray(raw[:, : 4 * cap]).view("<i4"), np.ascontiguousarray(raw[:, 4 * cap :]).view("<f8")
    ends = pa.array(np.arange(0, idx.size + 1, cap), pa.int32())
    return pa.table({"row_id": pa.array(ids), "idx": pa.ListArray.from_arrays(ends, pa.array(idx.ravel())), "val": pa.ListArray.from_arrays(ends, pa.array(val.ravel()))})


def read_postings(wanted: DataFrame, folder: str) -> DataFrame:
    """(row_id, idx, val) of the rows asked for, one read each; rows over the store's end are left out."""
    s = _settings(folder)
    cap, rows = s["cap"], s["rows"]
    stride = 12 * cap

    def read(files: fs.FileSystem, path: str, ids: np.ndarray) -> pa.Table:
        if not _there(files, path):
            raw = np.concatenate([np.full((len(ids), 4 * cap), 255, np.uint8), np.zeros((len(ids), 8 * cap), np.uint8)], axis=1)
            return _postings(ids, raw, cap)
        with files.open_input_file(path) as f:
            raw = b"".join(f.read_at(stride, int(i % rows) * stride) for i in ids)
        return _postings(ids, np.frombuffer(raw, np.uint8).reshape(-1, stride), cap)

    return _read(wanted.where((F.col("row_id") >= 0) & (F.col("row_id") < s["end"])), folder, rows, POSTINGS, read)


def scan_postings(spark: SparkSession, folder: str) -> DataFrame:
    """The whole store, a file a task, read in slices."""
    s = _settings(folder)
    cap, rows, end = s["cap"], s["rows"], s["end"]
    stride, step = 12 * cap, max(1, (8 << 20) // (12 * cap))

    def scan(batches):
        files, path = open_uri(folder)
        for b in batches:
            for number in b.column(0).to_pylist():
                name, last = f"{path}/{number:012d}.bin", min(rows, end - number * rows)
                if not _there(files, name):
                    continue
                with files.open_input_file(name) as f:
                    for at in range(0, last, step):
                        n = min(step, last - at)
                        raw = np.frombuffer(f.read_at(n * stride, at * stride), np.uint8).reshape(-1, stride)
                        yield from _postings(np.arange(n) + number * rows + at, raw, cap).to_batches()

    n_files = -(-end // rows)
    return spark.range(n_files, numPartitions=max(1, n_files)).mapInArrow(scan, POSTINGS)


# --- texts ---


def write_texts(passages: DataFrame, folder: str, rows: int = TEXT_ROWS) -> None:
    """A collection (pid, text): each file begins with offset and length of its ``rows`` texts (length -1 where there is none), then the texts in UTF-8."""

    def pack(t: pa.Table, first: int) -> bytes:
        places, texts, at = np.full((rows, 2), -1, "<i8"), [], 16 * rows
        for r, text in zip((t.column("row_id").to_numpy() - first).tolist(), t.column("text").to_pylist(), strict=True):
            if text is not None:
                places[r] = at, len(text)
                texts.append(text)
                at += len(text)
        return places.tobytes() + b"".join(texts)

    _written(passages.select(F.col("pid").cast("long").alias("row_id"), F.col("text").cast("binary").alias("text")), folder, rows, {}, pack)


def read_texts(wanted: DataFrame, folder: str) -> DataFrame:
    """(pid, text) of the passages asked for (pid), repeats and all: two reads each, of its place and of its bytes. Those without a text are left out."""
    s = _settings(folder)
    rows = s["rows"]

    def read(files: fs.FileSystem, path: str, ids: np.ndarray) -> pa.Table:
        found, texts = [], []
        if _there(files, path):
            with files.open_input_file(path) as f:
                for i in ids.tolist():
                    at, size = np.frombuffer(f.read_at(16, 16 * (i % rows)), "<i8").tolist()
                    if size >= 0:
                        found.append(i)
                        texts.append(f.read_at(size, at) if size else b"")
        return pa.table({"pid": pa.array(found, pa.int64()), "text": pa.array(texts, pa.binary()).cast(pa.string())})

    asked = wanted.select(F.col("pid").alias("row_id")).where((F.col("row_id") >= 0) & (F.col("row_id") < s["end"]))
    return _read(asked, folder, rows, "pid long, text string", read)


def is_whole(folder: str) -> bool:
    files, path = open_uri(folder)
    return _there(files, f"{path}/settings.json")
