"""Array artifacts: numpy stores to and from tables, JSON results."""

from __future__ import annotations

import io
import json
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postwright.sources.log import open_uri


def padded_to_postings(store: DataFrame, kind: str) -> DataFrame:
    """Rows (row_id, idx array, val array) to (kind, row_id, entry_id, weight, rank): padding (no weight) is left out, ranks are from 0."""
    return (
        store.select("row_id", F.posexplode(F.arrays_zip("idx", "val")).alias("rank", "p"))
        .where("p.val > 0 AND p.idx >= 0")
        .select(F.lit(kind).alias("kind"), "row_id", F.col("p.idx").cast("int").alias("entry_id"), F.col("p.val").cast("double").alias("weight"), "rank")
    )


def postings_to_padded(postings: DataFrame, cap: int) -> DataFrame:
    """The reverse: arrays of ``cap`` entries, padded with -1 and 0, heaviest first."""
    p = postings.where(F.col("rank") < cap).groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("rank", "entry_id", "weight"))).alias("p"))
    pad = lambda a, x: F.slice(F.concat(a, F.array_repeat(F.lit(x), cap)), 1, cap)
    return p.select("row_id", pad(F.transform("p", lambda s: s["entry_id"]), -1).alias("idx"), pad(F.transform("p", lambda s: s["weight"]), 0.0).alias("val"))


def read_npz(spark: SparkSession, path: str, row_id: str = "row_id") -> DataFrame:
    """A numpy archive of arrays of one length as a table: one column an array, rows numbered from 0 (S8). The archive is read by an executor."""

    def load(batches):
        for b in batches:
            for raw in b.column(0).to_pylist():
                with np.load(io.BytesIO(raw), allow_pickle=False) as z:
                    names = sorted(z.files)
                    n = len(z[names[0]])
                    cols = [pa.array(np.arange(n, dtype=np.int64))]
                    for k in names:
                        a = z[k]
                        cols.append(pa.array(a.astype(float)) if a.ndim == 1 and a.dtype.kind in "fiub" else pa.array([json.dumps(x) for x in a.tolist()]))
                yield pa.RecordBatch.from_arrays(cols, names=[row_id, *names])

    files = spark.read.format("binaryFile").load(path).select("content")
    head = files.mapInArrow(lambda bs: (pa.RecordBatch.from_arrays([pa.array([json.dumps(_kinds(r)) for r in b.column(0).to_pylist()])], names=["kinds"]) for b in bs), "kinds string").first()
    schema = ", ".join([f"{row_id} long", *(f"`{k}` {v}" for k, v in json.loads(head.kinds).items())])
    return files.mapInArrow(load, schema)


def save_npz(uri: str, **arrays: np.ndarray) -> None:
    """Arrays as one archive in any file system that the executors share (S8). For what fits the driver."""
    raw = io.BytesIO()
    np.savez(raw, **arrays)
    files, path = open_uri(uri)
    files.create_dir(path.rpartition("/")[0], recursive=True)
    with files.open_output_stream(path) as out:
        out.write(raw.getvalue())


def _kinds(raw: bytes) -> dict[str, str]:
    with np.load(io.BytesIO(raw), allow_pickle=False) as z:
        return {k: "double" if z[k].ndim == 1 and z[k].dtype.kind in "fiub" else "string" for k in sorted(z.files)}


def save_json(path: str, value: Any) -> None:
    """Numpy scalars and arrays become plain numbers (S15). For small results on the driver."""

    def plain(x):
        return x.item() if isinstance(x, np.generic) else x.tolist() if isinstance(x, np.ndarray) else str(x)

    files, path = open_uri(path)
    files.create_dir(path.rpartition("/")[0], recursive=True)
    with files.open_output_stream(path) as out:
        out.write(json.dumps(value, indent=2, default=plain, sort_keys=True).encode())


def load_json(path: str) -> Any:
    files, path = open_uri(path)
    with files.open_input_stream(path) as f:
        return json.loads(f.read())


def tagged(kind: str, tag: str | None = None, **more: str) -> str:
    """A table's name by what it holds: ``vocab``, ``vocab_legal``, ``proto_e5_legal``."""
    return "_".join([kind, *(str(v) for _, v in sorted(more.items())), *([tag] if tag else [])])
