"""Drawn probes, against plain versions."""

import hashlib

import numpy as np
import pytest

from postwright.functions.hashing import Md5Starts, sample_key
from postwright.operators import probes


def unit(rng, n, dim):
    x = rng.normal(size=(n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_md5_of_many_endings():
    ends = [str(i).encode() for i in (*range(120), 29_999, 123_456)] + [b""]
    for n in (0, 3, 5, 8, 49, 50, 55, 70):
        assert Md5Starts(ends).after(b"x" * n).tolist() == [int(hashlib.md5(b"x" * n + e).hexdigest()[:8], 16) for e in ends]


@pytest.mark.parametrize("n", [3, 150])
def test_drawn_entries_are_the_first_by_hash(spark, n):
    """the same draws as by sorting all hashes."""
    p = spark.createDataFrame([(i, i) for i in range(0, n, 2)] + [(7000, None)], "probe int, own_id int")
    e = spark.createDataFrame([(i,) for i in range(n)], "entry_id int")
    pairs = p.crossJoin(e).where("entry_id <> own_id").withColumn("h", sample_key("auc", "probe", "entry_id"))
    want = {}
    for r in sorted(pairs.collect(), key=lambda r: (r.probe, r.h, r.entry_id)):
        want.setdefault(r.probe, []).append(r.entry_id)
    got = {}
    for r in probes.random_targets(p, e).collect():
        got.setdefault(r.probe, []).append(r.entry_id)
    assert got == {k: v[:4] for k, v in want.items()}


def test_similarities_of_asked_entries_alone(spark):
    rng = np.random.default_rng(3)
    x, e = unit(rng, 9, 5), unit(rng, 7, 5)
    p = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "probe int, state array<double>")
    entries = spark.createDataFrame([(2 * i, v.tolist()) for i, v in enumerate(e)], "entry_id int, vec array<double>")
    asked = spark.createDataFrame([(i, j) for i in range(8) for j in (i, 12, 40)], "probe int, entry_id int").distinct()
    got = {(r.probe, r.entry_id): r.sim for r in probes.target_similarities(p, asked, entries, 5).collect()}
    want = {(r.probe, r.entry_id): r.sim for r in probes.target_ranks(p, asked, entries, 5).collect()}
    assert got == pytest.approx(want, abs=2e-8) and len(got) == len({(i, j) for i in range(8) for j in (i, 12) if j % 2 == 0})
