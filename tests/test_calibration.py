"""Calibration by frequency over all similarities, against plain versions and SQL."""

import hashlib
import itertools

import duckdb
import numpy as np
import pytest

from postwright.operators import insertion, postings
from postwright.plans import QUERIES


def unit(rng, n, dim):
    x = rng.normal(size=(n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.fixture(scope="module")
def axes(spark, tmp_path_factory):
    """Tables whose states are axes, so that similarities are 0 or 1: common words in all texts, others a hundred times in one."""
    d = tmp_path_factory.mktemp("axes")
    words = ["w" + "".join(x) for x in itertools.islice(itertools.product("abcdefgh", repeat=3), 40)]
    texts = [" ".join([w for w in words[:20] if (hash_of(w) + i) % 3] * 5) for i in range(40)]
    for k, w in enumerate(words[20:]):
        texts[k] += f" {w}" * (110 + k)
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, np.eye(64)[i].tolist()) for i in range(64)], "vec_id long, embedding array<double>").write.parquet(f"{d}/embeddings.parquet")
    return str(d)


def hash_of(w):
    return int(hashlib.md5(w.encode()).hexdigest()[:8], 16)


def test_a_shift_lifts_similarities_however_low(spark, axes):
    """a shift of a half lifts similarities of zero over the threshold; they were left out, so rare entries were shifted up at every step."""
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{axes}/{t}.parquet/*.parquet'")
    q = QUERIES["calibrate_frequency"]
    got = sorted((r.entry_id, round(r.shift, 5)) for r in q(spark, axes).collect())
    assert got and got == sorted((e, round(s, 5)) for e, s in c.sql(q.oracle()).project("entry_id, shift").fetchall())
    assert any(s > 0.05 for _, s in got) and all(s <= 0.5 for _, s in got)  # 1.55 before


@pytest.mark.parametrize("most", [3, 9, 1000])
def test_similarities_that_tell_counts_from_targets(spark, most):
    rng = np.random.default_rng(most)
    states, texts = unit(rng, 12, 6), [(p, sorted({int(x) for x in rng.integers(12, size=rng.integers(1, 6))})) for p in range(30)]
    targets = {e: float(t) for e, t in enumerate([0, 1, 2.5, 4, 8, 15, 29, 30])}
    entries = {e: states[e] if e % 2 else unit(rng, 1, 6)[0] for e in targets}
    s = spark.createDataFrame([(v, x.tolist()) for v, x in enumerate(states)], "vec_id long, state array<double>")
    e = spark.createDataFrame([(k, x.tolist()) for k, x in entries.items()] + [(99, [1.0] * 6)], "entry_id int, vec array<double>")
    t = spark.createDataFrame([(k, min(x, float(most))) for k, x in targets.items()], "entry_id int, target double")
    u = spark.createDataFrame(texts, "pid long, keys array<long>")
    few = postings.enough_for_counts(u, s, e, 6, t)
    every = postings.similarities(s, e.where("entry_id < 99"), 6)
    assert few.count() < every.count() and few.join(every, ["vec_id", "entry_id", "sim"]).count() == few.count()
    shifts = lambda x: {r.entry_id: r.shift for r in insertion.shift_of_counts(postings.pooled_counts(u, x, by_entry=True), t, 0.3).collect()}
    assert shifts(few) == shifts(every) and len(shifts(few)) == len(targets)
