"""Tables written once into the folder that driver and executors share."""

from __future__ import annotations

import hashlib
import json
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


#: Paths of tables written inside open ``scratch`` blocks, innermost last.
_open: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, a local session gets a folder of its own; on a cluster that is an error, as executors would write to their own disks."""
    key = "spark.checkpoint.dir"
    found = spark.sparkContext.getConf().get(key) or spark.conf.get(key, None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
        if not found and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = found or tempfile.mkdtemp(prefix="postwright-")
        spark.conf.set(key, found)
    return found.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write and read back. A lost executor costs no recomputation of what came before."""
    path = f"{shared_dir(df.sparkSession)}/postwright/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _open:
        _open[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Tables staged inside the block are removed at its end, but for the last one, which is its result."""
    _open.append([])
    try:
        yield _open[-1]
    finally:
        made = _open.pop()
        for path in made[:-1]:
            remove(spark, path)
        if _open:
            _open[-1] += made[-1:]


def fingerprint(settings: dict) -> str:
    """A name for a result: equal settings, equal name."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True, default=str).encode()).hexdigest()[:16]


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def files_of(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(name, bytes, time of change) of a table's files: what a result of it rests on."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p)
    return sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in found)


def cached_result(spark: SparkSession, folder: str, settings: dict, make) -> DataFrame:
    """The table that ``make()`` gives, computed once for these settings; a table counts as written when its commit marker is there."""
    path = f"{folder}/{fingerprint(settings)}"
    if not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def run_stages(spark: SparkSession, folder: str, stages: list[tuple[str, tuple[str, ...], Callable[..., DataFrame]]]) -> dict[str, tuple[DataFrame, bool]]:
    """Name to (table, whether it was made now) of stages (name, names of stages it reads, function of their tables) in any order that has an order.

    A stage whose commit marker is in ``folder`` is read and not made again, unless one that it reads was made anew; so a run that broke off goes on where it stopped.
    """
    left, done = {name: (needs, make) for name, needs, make in stages}, {}
    while left:
        ready = [name for name, (needs, _) in left.items() if all(n in done for n in needs)]
        if not ready:
            raise ValueError(f"stages wait for each other or for what is not there: {sorted(left)}")
        for name in ready:
            needs, make = left.pop(name)
            path = f"{folder}/{name}"
            fresh = not exists(spark, f"{path}/_SUCCESS") or any(done[n][1] for n in needs)
            if fresh:
                make(*[done[n][0] for n in needs]).write.mode("overwrite").parquet(path)
            done[name] = (spark.read.parquet(path), fresh)
    return done
