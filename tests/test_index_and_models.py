"""The stored index, tails, intervals, prototypes, training, clusters and refresh, against plain versions."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from postwright.operators import clusters, diagnostics, encoder, impact_index, postings, probes, refresh, search, sparse_training, tokens


def unit(rng, n, dim):
    x = rng.normal(size=(n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def vectors(spark, x, key="entry_id", vec="vec", kind="int"):
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], f"{key} {kind}, {vec} array<double>")


# --- index ---


@pytest.fixture(scope="module")
def store(spark):
    """Postings with an entry that is everywhere, rare ones, equal weights, and queries with unknown entries and weights of zero."""
    rng = np.random.default_rng(3)
    d = {(p, 0): 0.5 for p in range(400)}
    for p in range(400):
        for e in rng.choice(np.arange(1, 60), 8, replace=False):
            d[p, int(e)] = float(np.round(rng.random() ** 3, 2))
    q = {(i, int(e)): float(np.round(rng.random(), 2)) for i in range(12) for e in rng.choice(70, 6, replace=False)} | {(i, 0): 0.1 for i in range(12)} | {(20, 99): 1.0, (21, 0): 0.0}
    rows = lambda x: [(*k, v) for k, v in x.items()]
    return spark.createDataFrame(rows(q), "qid long, entry_id int, weight double"), spark.createDataFrame(rows(d), "pid long, entry_id int, weight double")


@pytest.mark.parametrize(("block", "k"), [(8, 5), (8, 40), (64, 10), (1000, 10)])
def test_index_finds_what_the_join_finds(spark, store, tmp_path, block, k):
    q, d = store
    found = impact_index.search(impact_index.build(d, f"{tmp_path}/i", block), q, k)
    rows = lambda df: sorted((r.qid, r["rank"], r.pid, r.score) for r in df.collect())
    assert rows(found.run) == rows(search.search(q, d, k))


def test_index_skips_blocks_and_outlives_its_session(spark, store, tmp_path):
    q, d = store
    impact_index.build(d, f"{tmp_path}/i", 8)
    other = spark.newSession()
    index = impact_index.open_index(other, f"{tmp_path}/i")
    work = impact_index.search(index, other.createDataFrame(q.collect(), q.schema), 5).work.agg(F.sum("blocks").alias("blocks"), F.sum("opened").alias("opened")).first()
    assert 0 < work.opened < 0.7 * work.blocks
    assert index.lists.agg(F.max(F.size("hits"))).first()[0] <= 8
    with pytest.raises(FileNotFoundError):
        impact_index.open_index(spark, f"{tmp_path}/none")
    empty = impact_index.search(impact_index.build(d.where("false"), f"{tmp_path}/e"), q, 5)
    assert empty.run.count() == 0 and empty.work.count() == 0


def test_bounds_hold(spark, store, tmp_path):
    """No text of a block scores over its bound."""
    q, d = store
    index = impact_index.build(d, f"{tmp_path}/i", 16)
    scored = search.scores(q, d).join(index.places, "pid")
    worst = scored.join(impact_index.bounds(index, q), ["qid", "block"]).agg(F.min(F.col("bound") - F.col("score"))).first()[0]
    assert worst >= -1e-9 and index.places.count() == 400


def test_stored_tables_follow_their_files(spark, tmp_path):
    from postwright.plans.world import World

    made = []
    w = World(spark, str(tmp_path))
    make = lambda: made.append(1) or spark.read.parquet(f"{tmp_path}/t.parquet")
    spark.range(3).write.parquet(f"{tmp_path}/t.parquet")
    assert [w.stored("x", ["t"], make).count() for _ in range(2)] == [3, 3] and len(made) == 1
    spark.range(5).write.mode("overwrite").parquet(f"{tmp_path}/t.parquet")
    assert w.stored("x", ["t"], make).count() == 5 and len(made) == 2


# --- tails, targets, intervals ---


@pytest.mark.parametrize("m", [1, 8, 40, 90, 500])
def test_nth_largest_against_a_sort(spark, monkeypatch, m):
    """Also where m is larger than a slice or the bank; entries of several atoms and vectors longer than one."""
    monkeypatch.setattr(postings, "SLICE_CELLS", 8 * postings.BINS)
    rng = np.random.default_rng(m)
    x, e = unit(rng, 90, 5) * 3, unit(rng, 30, 5) * 1.7
    entries = spark.createDataFrame([(i // 2, r.tolist()) for i, r in enumerate(e)], "entry_id int, vec array<double>")
    got = {r.entry_id: r.tail for r in postings.nth_largest(vectors(spark, x, "vec_id", "state", "long"), entries, 5, m).collect()}
    sims = np.round(x @ e.T, 8).reshape(90, 15, 2).max(axis=2)
    assert got == {i: np.sort(sims[:, i])[::-1][min(m, 90) - 1] for i in range(15)}


def test_nth_largest_of_nothing(spark):
    e = vectors(spark, np.eye(3))
    assert postings.nth_largest(e.where("false").select(F.col("entry_id").cast("long").alias("vec_id"), F.col("vec").alias("state")), e, 3, 2).count() == 0


def test_targets_and_firing_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    x, e = unit(rng, 20, 4), unit(rng, 12, 4)
    sims = np.round(x @ e.T, 8)
    p, entries = vectors(spark, x, "probe", "state"), vectors(spark, e)
    asked = [(i, j) for i in range(20) for j in range(12) if (i + j) % 3 == 0] + [(0, 99)]
    got = {(r.probe, r.entry_id): (r.sim, r["rank"]) for r in probes.target_ranks(p, spark.createDataFrame(asked, "probe int, entry_id int"), entries, 4).collect()}
    assert got == {(i, j): (sims[i, j], int((sims[i] > sims[i, j]).sum()) + 1) for i, j in asked if j < 12}
    cuts = [("a", j, 0.1 * j - 0.5) for j in range(12)] + [("b", 3, 0.0), ("b", 50, 0.0)]
    fired = {(r.name, r.entry_id): (r.n, r.fired) for r in postings.firing_counts(p.select(F.col("probe").cast("long").alias("vec_id"), "state"), entries, 4, spark.createDataFrame(cuts, "name string, entry_id int, cut double")).collect()}
    assert fired == {(n, j): (20, int((sims[:, j] > c).sum())) for n, j, c in cuts if j < 12}


def test_nearest_entries_across_slices(spark, monkeypatch):
    monkeypatch.setattr(postings, "SLICE_CELLS", 30)
    rng = np.random.default_rng(6)
    x, e = np.round(unit(rng, 25, 2), 1), np.round(unit(rng, 9, 2), 1)
    got = sorted((r.vec_id, r.entry_id) for r in postings.nearest_entries(vectors(spark, x, "vec_id", "state", "long"), vectors(spark, e), 2, 3).collect())
    sims = np.round(x @ e.T, 8)
    assert got == sorted((i, int(j)) for i in range(25) for j in np.lexsort((np.arange(9), -sims[i]))[:3])


def test_entries_over_the_bound_are_refused(spark, monkeypatch):
    monkeypatch.setattr(postings, "BLOCK_BYTES", 64)
    monkeypatch.setattr(postings.entry_blocks, "__defaults__", (64,))
    with pytest.raises(ValueError):
        postings.sent_entries(vectors(spark, np.eye(4)), 4)


def test_late_interaction_sent_or_joined(spark, monkeypatch):
    rng = np.random.default_rng(7)
    x = unit(rng, 10, 4)
    q, d = {0: [1, 2, 2], 1: [3]}, {5: [4, 5, 6], 6: [7], 7: [1, 2]}
    units = lambda t, key: spark.createDataFrame([(k, v) for k, vs in t.items() for v in vs], f"{key} long, vec_id long")
    pairs = spark.createDataFrame(list(itertools.product(q, d)), "qid long, pid long")
    want = {(i, p): float((x[sorted(set(q[i]))] @ x[d[p]].T).max(axis=1).sum()) for i in q for p in d}
    for most in (1 << 20, 0):
        monkeypatch.setattr(search, "SENT_BYTES", most)
        got = {(r.qid, r.pid): r.score for r in search.late_interaction(pairs, units(q, "qid"), units(d, "pid"), vectors(spark, x, "vec_id", "state", "long"), 4).collect()}
        assert got == pytest.approx(want)


@pytest.mark.parametrize("cell", [1, 7, 64])
def test_intervals_against_all_pairs(spark, cell):
    rng = np.random.default_rng(cell)
    a = [(p, int(s), int(s + rng.integers(0, 30))) for p in range(3) for s in rng.integers(0, 200, 40)] + [(0, 0, 500), (1, None, 4), (1, 9, 3)]
    b = [(p, int(s), int(s + rng.integers(0, 5)), r) for p in range(3) for r, s in enumerate(rng.integers(0, 200, 30))] + [(0, 10, 400, 99), (2, 5, None, 77)]
    got = tokens.overlapping(spark.createDataFrame(a, "pid long, start long, stop long"), spark.createDataFrame(b, "pid long, start long, stop long, run int"), cell).collect()
    ok = lambda *x: None not in x and x[0] <= x[1]
    want = sorted((p, s, e, r) for p, s, e in a for o, t, f, r in b if p == o and ok(s, e) and ok(t, f) and s < f and e > t)
    assert sorted(tuple(r) for r in got) == want


def test_a_million_intervals_of_one_text(spark):
    n = 1_000_000
    pieces = spark.range(n).select(F.lit(0).alias("pid"), (F.col("id") * 6).alias("start"), (F.col("id") * 6 + 6).alias("stop"))
    runs = spark.range(n).select(F.lit(0).alias("pid"), (F.col("id") * 6 + 3).alias("start"), (F.col("id") * 6 + 9).alias("stop"), F.col("id").alias("run"))
    assert tokens.overlapping(pieces, runs).count() == 2 * n - 1


# --- prototypes ---


def test_stability_curve_against_plain_sums(spark):
    rng = np.random.default_rng(8)
    bank, sizes, half = unit(rng, 40, 6), (1, 2, 4), 4
    occ = {e: unit(rng, n, 6) for e, n in enumerate([8, 8, 7, 5, 4, 1])}  # the last two have no second half
    rows = [(e, i, v.tolist()) for e, x in occ.items() for i, v in enumerate(x)] + [(0, 8, [9.0] * 6)]  # a slot too many
    protos = diagnostics.nested_prototypes(spark.createDataFrame(rows, "entry_id int, slot int, state array<double>"), sizes, half)
    got = {r.k: r for r in diagnostics.stability_curve(protos, vectors(spark, bank, "pid", "vec", "long"), 6, 5).collect()}
    norm = lambda v: v / np.linalg.norm(v)
    for k in sizes:
        jac, cos = [], []
        for x in (occ[e] for e in range(4)):
            a, b = norm(x[:k].sum(axis=0)), norm(x[half : half + k].sum(axis=0))
            near = [set(np.argsort(-np.round(bank @ v, 8), kind="stable")[:5].tolist()) for v in (a, b)]
            jac.append(len(near[0] & near[1]) / len(near[0] | near[1]))
            cos.append(a @ b)
        assert got[k].n == 4 and got[k].jaccard == pytest.approx(np.mean(jac)) and got[k].cosine == pytest.approx(np.mean(cos))


# --- training ---


def toy_training(spark, rng, n=24, dim=4):
    states = unit(rng, 30, dim)
    rows = [(i, [int(v) for v in rng.choice(30, 3, replace=False)], [[int(v) for v in rng.choice(30, rng.integers(1, 5), replace=False)] for _ in range(rng.integers(1, 4))]) for i in range(n)]
    entries = unit(rng, 9, dim)
    affine = [(j, 1 + 0.1 * j, 0.01 * j) for j in range(9)]
    frames = (spark.createDataFrame(rows, "example long, query array<long>, docs array<array<long>>"), vectors(spark, states, "vec_id", "state", "long"), vectors(spark, entries), spark.createDataFrame(affine, "entry_id int, a double, b double"))
    return rows, states, entries, np.array([[a for _, a, _ in affine], [b for *_, b in affine]]), frames


@pytest.mark.parametrize("kind", ["mlp", "linear"])
def test_gradients_are_differences(spark, kind):
    rng = np.random.default_rng(9)
    rows, states, entries, affine, _ = toy_training(spark, rng)
    s = sparse_training.Settings(dim=4, hidden=5, head=kind, scale=6.0, bias=0.5)
    head = {k: v + rng.normal(size=v.shape) * 0.1 for k, v in sparse_training.first_head(s).items()}
    q, d = [states[r[1]] for r in rows[:6]], [[states[v] for v in r[2]] for r in rows[:6]]

    def loss(values):
        f, _ = sparse_training.part_loss(sparse_training.shaped(values, head), entries, affine, q, d, 0.3, 0.2)
        return f["ce"] + 0.3 * f["flops_q"] + 0.2 * f["flops_d"]

    at = sparse_training.flat(head, head)
    _, grad = sparse_training.part_loss(head, entries, affine, q, d, 0.3, 0.2)
    step = 1e-6 * np.eye(len(at))
    assert np.allclose([(loss(at + h) - loss(at - h)) / 2e-6 for h in step], sparse_training.flat(grad, head), atol=1e-6)


def test_training_equals_a_plain_loop_and_goes_on(spark, tmp_path):
    rng = np.random.default_rng(10)
    rows, states, entries, affine, frames = toy_training(spark, rng)
    s = sparse_training.Settings(dim=4, hidden=5, scale=6.0, batches=3, shards=2, steps=7, rate=0.02, warmup=3, clip=0.5, lam_q=0.05, lam_d=0.02, every=2, drop=0.3)
    place = {}
    for epoch in range(3):
        dealt = frames[0].select("example", sparse_training.batch_of(F.col("example"), epoch, s).alias("b"), sparse_training.shard_of(F.col("example"), s).alias("h"))
        place[epoch] = {r.example: (r.b, r.h) for r in dealt.collect()}
    from postwright.operators.training import dropout_mask

    kept = [sorted(r.entry_id for r in dropout_mask(frames[2], step, 0.3).collect()) for step in range(7)]
    head = sparse_training.first_head(s)
    w, m, v, ce = sparse_training.flat(head, head), 0.0, 0.0, []
    for step in range(7):
        parts = []
        for shard in range(2):
            own = [r for r in rows if place[step // 3][r[0]] == (step % 3, shard)]
            if own:
                lam = min(1.0, ((step + 1) / 1) ** 2) * 9 / len(kept[step])
                f, g = sparse_training.part_loss(sparse_training.shaped(w, head), entries[kept[step]], affine[:, kept[step]], [states[sorted(r[1])] for r in own], [[states[sorted(x)] for x in r[2]] for r in own], 0.05 * lam, 0.02 * lam)
                parts.append((len(own), f["ce"], sparse_training.flat(g, head)))
        n = sum(p[0] for p in parts)
        ce.append(sum(k * c for k, c, _ in parts) / n)
        g = sum(k * x for k, _, x in parts) / n
        g = g * min(1.0, 0.5 / (np.linalg.norm(g) + 1e-6))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        rate = 0.02 * min(1, (step + 1) / 3) * (1 if step < 3 else 1 - (step - 3) / 4)
        w = w - rate * 0.01 * w - rate * (m / (1 - 0.9 ** (step + 1))) / (np.sqrt(v / (1 - 0.999 ** (step + 1))) + 1e-8)
    half = sparse_training.train(*frames, s, f"{tmp_path}/run", until=5)
    assert half.step == 4  # the fifth step came after the last checkpoint
    end = sparse_training.train(*frames, s, f"{tmp_path}/run")
    history = end.history.orderBy("step").collect()
    assert [r.step for r in history] == list(range(7)) and np.allclose([r.ce for r in history], ce)
    assert end.step == 7 and np.allclose(sparse_training.flat(end.head, head), w) and np.allclose(end.m, m) and np.allclose(end.v, v)
    again = sparse_training.load(spark, f"{tmp_path}/run")
    assert again.settings == s and again.entries.count() == 9 and again.affine.count() == 9
    with pytest.raises(ValueError):
        sparse_training.train(*frames, sparse_training.Settings(dim=4), f"{tmp_path}/run")


def test_a_new_head_is_the_identity_and_training_lowers_the_loss(spark, tmp_path):
    rng = np.random.default_rng(11)
    *_, frames = toy_training(spark, rng, 40)
    s = sparse_training.Settings(dim=4, hidden=8, scale=5.0, batches=1, shards=1, steps=12, rate=0.05, warmup=1, lam_q=0.0, lam_d=0.0, every=12)
    end = sparse_training.train(*frames, s, f"{tmp_path}/run")
    ce = [r.ce for r in end.history.orderBy("step").collect()]
    assert ce[-1] < 0.9 * ce[0]
    start = sparse_training.load(spark, f"{tmp_path}/run", 0)
    same = sparse_training.applied(frames[1], start).join(frames[1].withColumnRenamed("state", "was"), "vec_id").collect()
    assert all(np.allclose(r.state, r.was) for r in same)
    with pytest.raises(FileNotFoundError):
        sparse_training.load(spark, f"{tmp_path}/none")


# --- clusters ---


def test_kmeans_against_a_loop(spark):
    """Several starts, equal vectors (so that centres fall empty and are put elsewhere), few rows."""
    rng = np.random.default_rng(12)
    x = unit(rng, 30, 3)
    x[10:18] = x[0]
    v = vectors(spark, x * 2)
    key = lambda seed, i: (__import__("hashlib").md5(f"{seed}|{i}".encode()).hexdigest(), i)
    best = None
    for s in range(3):
        c = x[sorted(range(30), key=lambda i, s=s: key(f"kmeans/7/{s}", i))[:6]]
        for r in range(5):
            sim = np.round(x @ c.T, 8)
            own = sim.argmax(axis=1)
            total = round(sim.max(axis=1).sum(), 6)
            new = []
            for e in range(6):
                y = x[own == e].sum(axis=0) if (own == e).any() else x[min(range(30), key=lambda i, s=s, r=r, e=e: key(f"reseed/7/{s}/{r}/{e}", i))]
                new.append(y / np.linalg.norm(y))
            c = np.array(new)
        if best is None or total > best[0]:
            best = (total, own)
    got = {r.entry_id: r.cluster for r in clusters.spherical_kmeans(v, 6, rounds=5, starts=3).collect()}
    assert [got[i] for i in range(30)] == best[1].tolist()
    assert {r.cluster for r in clusters.spherical_kmeans(v.limit(2), 6).collect()} <= {0, 1}
    assert clusters.spherical_kmeans(v.where("false"), 3).count() == 0
    with pytest.raises(ValueError):
        clusters.spherical_kmeans(v, 30, starts=1 << 20)


def test_small_problems_at_once(spark, monkeypatch):
    monkeypatch.setattr(clusters, "SLICE_CELLS", 200)
    rng = np.random.default_rng(13)
    groups = {e: rng.normal(size=(n, 3)) for e, n in enumerate([1, 2, 9, 20, 20, 5])}
    groups[3][5:] = groups[3][0]
    rows = [(e, i, v.tolist()) for e, x in groups.items() for i, v in enumerate(x)]
    got = {(r.entry_id, r.atom): r.vec for r in clusters.atoms(spark.createDataFrame(rows, "entry_id int, slot int, vec array<double>"), 4, rounds=6).collect()}
    for e, x in groups.items():
        c = x[:4].copy()
        for _ in range(6):
            own = np.round((c * c).sum(axis=1) - 2 * x @ c.T, 8).argmin(axis=1)
            c = np.array([x[own == a].mean(axis=0) if (own == a).any() else x[0] for a in range(len(c))])
        assert np.allclose([got.pop((e, a)) for a in range(len(c))], c)
    assert not got


# --- refresh ---


def test_only_changed_entries_are_encoded_again(spark, tmp_path):
    rng = np.random.default_rng(14)
    x = unit(rng, 10, 4)
    enc = encoder.LookupEncoder(encoder.EncoderSpec("lookup", 4), vectors(spark, x, "vec_id", "embedding", "long"), 10)
    frame = lambda rows: spark.createDataFrame(rows, "entry_id int, pid long, slot int, vec_id long")
    first = [(0, 1, 0, 3), (0, 2, 1, 4), (1, 1, 0, 5), (2, 9, 0, 6)]
    second = [*first[:3], (1, 3, 1, 7), (3, 4, 0, 8)]
    assert refresh.refresh(f"{tmp_path}/e", frame(first), enc) == 0 and refresh.refresh(f"{tmp_path}/e", frame(second), enc) == 1
    assert spark.read.parquet(f"{tmp_path}/e/version=1").count() == 2
    norm = lambda v: v / np.linalg.norm(v)
    want = {0: (0, norm(x[3] + x[4])), 1: (1, norm(x[5] + x[7])), 2: (0, x[6]), 3: (1, x[8])}
    got = {r.entry_id: (r.version, r.vec) for r in refresh.entries_at(spark, f"{tmp_path}/e").collect()}
    assert set(got) == set(want) and all(got[e][0] == v and np.allclose(got[e][1], y) for e, (v, y) in want.items())
    old = {r.entry_id: r.vec for r in refresh.entries_at(spark, f"{tmp_path}/e", 0).collect()}
    assert set(old) == {0, 1, 2} and np.allclose(old[1], x[5])
    d = {r.entry_id: r.cosine for r in refresh.drift(spark, f"{tmp_path}/e", 1).collect()}
    assert set(d) == {1, 3} and d[3] is None and math.isclose(d[1], float(x[5] @ norm(x[5] + x[7])))
    assert refresh.refresh(f"{tmp_path}/e", frame(second), enc) == 2 and spark.read.schema(refresh.SCHEMA).parquet(f"{tmp_path}/e/version=2").count() == 0
    assert refresh.entries_at(spark, f"{tmp_path}/none").count() == 0


# --- grids ---


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_grid_cells_ranked_in_tasks_or_by_window(spark, monkeypatch, store, most):
    """Every cell is a search of its own with its cuts, whichever way the best are kept."""
    monkeypatch.setattr(search, "GRID_BYTES", most)
    monkeypatch.setattr(search, "SENT_POSTINGS", most)
    q, d = (df.withColumn("rank", F.row_number().over(__import__("pyspark").sql.Window.partitionBy(key).orderBy(F.desc("weight"), "entry_id")) - 1) for df, key in zip(store, ("qid", "pid"), strict=True))
    cells = [(0, 3, 4, 0.0, 0.0, "none"), (1, 6, 9, 0.1, 0.05, "log1p"), (2, 1, 2, 0.3, 0.0, "none")]
    grid = spark.createDataFrame(cells, "cell int, k_q int, k_d int, tau_q double, tau_d double, saturation string")
    got = sorted((r.cell, r.qid, r["rank"], r.pid, round(r.score, 8)) for r in search.grid_search(q, d, grid, 4).collect())
    want = []
    for cell, k_q, k_d, tau_q, tau_d, kind in cells:
        cut = lambda df, k, tau, kind=kind: df.where((F.col("rank") < k) & (F.col("weight") > tau)).withColumn("weight", F.log1p(F.col("weight") - tau) if kind == "log1p" else F.col("weight") - tau)
        want += [(cell, r.qid, r["rank"], r.pid, round(r.score, 8)) for r in search.search(cut(q, k_q, tau_q), cut(d, k_d, tau_d), 4).collect()]
    assert got == sorted(want)


def test_grid_pairs_never_become_rows(spark, store):
    """Scores of a grid are matrix products over batches of passages: no join of postings, and the same best whatever the batches."""
    order = lambda key: F.row_number().over(__import__("pyspark").sql.Window.partitionBy(key).orderBy(F.desc("weight"), "entry_id")) - 1
    q, d = (df.withColumn("rank", order(key)) for df, key in zip(store, ("qid", "pid"), strict=True))
    grid = spark.createDataFrame([(0, 3, 4, 0.0, 0.0, "none"), (1, 6, 9, 0.1, 0.05, "log1p")], "cell int, k_q int, k_d int, tau_q double, tau_d double, saturation string")
    found = {}
    for rows in (2, 10_000):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
        run = search.grid_search(q, d, grid, 3)
        assert "Join" not in run._jdf.queryExecution().optimizedPlan().toString()
        found[rows] = sorted(tuple(r) for r in run.collect())
    assert found[2] == found[10_000] and found[2]


def test_tails_in_blocks_of_entries_and_small_slices(spark, monkeypatch):
    """Slices of a product are far smaller than the histograms that a task holds, which have a bound of their own."""
    rng = np.random.default_rng(21)
    states, entries = unit(rng, 90, 4), unit(rng, 21, 4)
    assert postings.SLICE_CELLS * 8 <= postings.HELD_BINS
    monkeypatch.setattr(postings, "SLICE_CELLS", 64)
    monkeypatch.setattr(postings, "HELD_BINS", 8 * postings.BINS)
    s, e = vectors(spark, states, "vec_id", "state", "long"), vectors(spark, entries, "entry_id", "vec", "int")
    got = {r.entry_id: r.tail for r in postings.nth_largest(s, e, 4, 7).collect()}
    want = np.sort(np.round(states @ entries.T, 8), axis=0)[-7]
    assert all(math.isclose(got[k], x, abs_tol=1e-12) for k, x in enumerate(want)) and len(got) == 21
