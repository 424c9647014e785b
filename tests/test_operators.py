"""Operators on toy tables, by hand or against plain loops."""

import json
import math
import random

import numpy as np
import pytest

from postwright.functions import numeric, vectors
from postwright.operators import decisions, diagnostics, geometry, insertion, metrics, ordering, postings, search, tokens, training, vocabulary
from pyspark.sql import functions as F


@pytest.fixture
def toy(spark):
    """Three queries, four documents, five entries: a tie, a dead entry (4), an empty document (3), a document at its cap."""
    q = spark.createDataFrame([(0, 0, 1.0, 0), (0, 1, 0.5, 1), (1, 1, 1.0, 0), (2, 3, 2.0, 0)], "qid long, entry_id int, weight double, rank int")
    d = spark.createDataFrame([(0, 0, 2.0, 0), (0, 1, 1.0, 1), (1, 1, 1.0, 0), (2, 1, 1.0, 0), (2, 2, 0.5, 1)], "pid long, entry_id int, weight double, rank int")
    return q, d


def test_posting_join_scores_and_ties(toy):
    run = {(r.qid, r.pid): (r.score, r.rank) for r in search.search(*toy, 10).collect()}
    assert run == {(0, 0): (2.5, 1), (0, 1): (0.5, 2), (0, 2): (0.5, 3), (1, 0): (1.0, 1), (1, 1): (1.0, 2), (1, 2): (1.0, 3)}  # query 2 matches nothing


def test_metrics_by_hand(spark, toy):
    qrels = spark.createDataFrame([(0, 2), (0, 3), (1, 0), (2, 0)], "qid long, pid long")
    got = {r.qid: r for r in metrics.per_query(search.search(*toy, 10), qrels).collect()}
    assert set(got) == {0, 1}  # a query without a ranking does not count
    assert got[0].mrr == pytest.approx(1 / 3) and got[0].r10 == 0.5 and got[0].ndcg == pytest.approx((1 / 2) / (1 + 1 / math.log2(3)))
    assert got[1].mrr == 1 and got[1].ndcg == 1


def test_alias_weights_add_up(spark, toy):
    alias = spark.createDataFrame([(1, 0)], "entry_id int, alias int")
    got = {(r.qid, r.entry_id): r.weight for r in search.aliased(toy[0], alias).collect()}
    assert got == {(0, 0): 1.5, (1, 0): 1.0, (2, 3): 2.0}


def test_negatives_are_cut_before_positives_leave(spark):
    run = spark.createDataFrame([(0, p, 1.0, p + 1) for p in range(5)], "qid long, pid long, score double, rank int")
    got = search.hard_negatives(run, spark.createDataFrame([(0, 1)], "qid long, pid long"), 3)
    assert sorted(r.pid for r in got.collect()) == [0, 2]


def test_capped_store_evicts(spark, toy):
    merged = toy[1].union(spark.createDataFrame([(0, 9, 5.0, 0), (0, 8, 4.0, 0)], "pid long, entry_id int, weight double, rank int"))
    ins = spark.createDataFrame([(8,), (9,)], "entry_id int")
    r = postings.evictions(postings.capped(merged, 2), postings.capped(toy[1], 2), ins, 2).first()
    assert r.mean_lost == pytest.approx(2 / 3) and r.share_losing == pytest.approx(1 / 3)


def test_dead_entries_count(spark, toy):
    entries = spark.range(5).select(F.col("id").cast("int").alias("entry_id"))
    assert {r.entry_id: (r.df, r.mean_weight) for r in postings.document_frequency(toy[1], entries).collect()} == {0: (1, 2.0), 1: (3, 1.0), 2: (1, 0.5), 3: (0, 0.0), 4: (0, 0.0)}
    assert postings.density(toy[1], spark.range(4).withColumnRenamed("id", "pid"), 2).first().mean_nnz == 1.25


def test_tau_leaves_the_target(spark):
    rng = random.Random(0)
    rows = [(i % 20, i, round(rng.random(), 6)) for i in range(2000)]
    profile = spark.createDataFrame(rows, "pid long, entry_id int, sim double")
    tau = postings.fit_tau(profile, 20, 30)
    assert abs(sum(s > tau for *_, s in rows) - 600) <= 2


def test_products_take_the_best_atom(spark):
    states = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, state array<double>")
    entries = spark.createDataFrame([(5, [1.0, 0.0]), (5, [0.6, 0.8]), (7, [-1.0, 0.0])], "entry_id int, vec array<double>")
    got = {(r.vec_id, r.entry_id): r.sim for r in postings.similarities(states, entries, 2).collect()}
    assert got == {(0, 5): 1.0, (1, 5): 0.8, (0, 7): -1.0, (1, 7): 0.0}
    assert {(r.vec_id, r.entry_id): r.sim for r in postings.similarities(states, entries.where("entry_id = 5 AND vec[0] = 1 OR entry_id = 7"), 2, block_bytes=16).collect()}[0, 7] == -1.0
    assert postings.similarities(states, entries.where("false"), 2).count() == 0


def test_prefix_sums_over_many_partitions(spark):
    rows = [(i * 7 % 1000, i % 13) for i in range(1000)]
    got = ordering.prefix_sums(spark.createDataFrame(rows, "k long, v long").repartition(9), ["k"], {"s": F.col("v"), "n": F.lit(1)}).collect()
    by, total = dict(rows), 0
    for r in sorted(got, key=lambda r: r.k):
        assert (r.s, r.n) == (total, r.k)
        total += by[r.k]


@pytest.mark.parametrize("seed", range(5))
def test_auc_counts_pairs(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.randint(0, 6), rng.randint(0, 1)) for _ in range(30)] + [(None, 1), (3, None)]
    pos, neg = [s for s, y in rows if y == 1 and s is not None], [s for s, y in rows if y == 0]
    want = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
    assert metrics.auc(spark.createDataFrame(rows, "s int, y int"), "s", "y").first().auc == pytest.approx(want)
    assert metrics.auc(spark.createDataFrame([(1, 1)], "s int, y int"), "s", "y").first().auc is None


def test_paired_bootstrap_of_equal_runs(spark):
    a = spark.createDataFrame([(i, 0.5) for i in range(10)], "qid long, m double")
    r = metrics.paired_bootstrap(a, a, "m", 50).first()
    assert (r.diff, r.lo, r.hi, r.p, r.excludes_zero) == (0, 0, 0, 1.0, False)


def test_bootstrap_is_near_the_normal_interval(spark):
    x = np.random.default_rng(0).normal(size=60)
    r = metrics.bootstrap_interval(spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "qid long, m double"), "m", 600).first()
    half = 1.96 * x.std() / math.sqrt(60)
    assert r.mean == pytest.approx(x.mean()) and r.lo == pytest.approx(x.mean() - half, abs=0.05) and r.hi == pytest.approx(x.mean() + half, abs=0.05)


def test_recovery_ratio_by_definition(spark):
    rng = random.Random(1)
    base = [(i, rng.random() * 0.2) for i in range(30)]
    frame = lambda add: spark.createDataFrame([(i, v + add) for i, v in base], "qid long, m double")
    r = metrics.recovery_ratio(frame(0.3), frame(0.0), frame(0.4), frame(0.0), "m", 100).first()
    assert r.rho == pytest.approx(0.75) and r.lo == pytest.approx(0.75) and r.valid
    assert not metrics.recovery_ratio(frame(0.0), frame(0.0), frame(0.01), frame(0.0), "m", 50).first().valid


def test_frequency_shift_against_a_loop(spark):
    rng = random.Random(2)
    rows = [(p, e, round(rng.random(), 4)) for p in range(40) for e in range(4)]
    targets = {0: 5, 1: 20, 2: 0, 3: 40}
    got = {r.entry_id: r.shift for r in insertion.shift_to_frequency(spark.createDataFrame(rows, "pid long, entry_id int, sim double"), spark.createDataFrame(list(targets.items()), "entry_id int, target int"), 0.5).collect()}
    for e, t in targets.items():
        shift = 0.0
        for i in range(12):
            df = sum(s + shift > 0.5 for _, x, s in rows if x == e)
            shift += 0.5 / (i + 1) * ((df < t) - (df > t))
        assert got[e] == pytest.approx(shift)


@pytest.mark.parametrize("mode", ["all", "topk", "dfdrop"])
def test_gates_leave_quiet_queries_alone(spark, mode):
    q = spark.createDataFrame([(0, e, 1.0 - e / 10) for e in range(6)] + [(1, 0, 1.0), (1, 9, 1.0)], "qid long, entry_id int, weight double")
    ins = spark.createDataFrame([(e,) for e in (1, 2, 3, 9)], "entry_id int")
    rates = spark.createDataFrame([(1, 0.5), (2, 0.01), (3, 0.9)], "entry_id int, rate double")
    got = {}
    for r in insertion.gate(q, ins, 2, mode, rates, 0.05).collect():
        got.setdefault(r.qid, set()).add(r.entry_id)
    assert got[1] == {0, 9}
    assert got[0] == {"all": {0, 4, 5}, "topk": {0, 1, 2, 4, 5}, "dfdrop": {0, 2, 4, 5}}[mode]


def test_unknown_names_are_refused(spark, toy):
    with pytest.raises(ValueError):
        insertion.gate(toy[0], toy[1].select("entry_id"), 1, "nonsense")
    with pytest.raises(ValueError):
        insertion.select_candidates(toy[0], 1, "nonsense", 1)


def test_greedy_clusters_skip(spark):
    c = spark.createDataFrame([(i, s) for i, s in enumerate([30, 10, 6, 4, 50])], "cluster int, size long")
    kept = [r.cluster for r in vocabulary.held_clusters(c, 100).collect()]
    total = sum([30, 10, 6, 4, 50][k] for k in kept)
    assert set(kept) <= {1, 2, 3} and (15 <= total <= 25 or total == 20)


def test_decile_is_not_ntile(spark):
    counts = spark.createDataFrame([(f"w{i:02d}", 100 - i) for i in range(23)], "word string, freq long")
    got = [r.decile for r in vocabulary.vocabulary(counts, 1).orderBy("entry_id").collect()]
    assert got == [min(i * 10 // 23, 9) for i in range(23)]


def test_units_of_unicode_and_ascii(spark):
    p = spark.createDataFrame([(1, "Café au-lait 3x"), (2, None), (3, "")], "pid long, text string")
    assert [r.word for r in tokens.tokens(p).orderBy("pos").collect()] == ["caf", "au", "lait", "3x"]
    assert [r.word for r in tokens.tokens(p, unicode=True).orderBy("pos").collect()] == ["café", "au", "lait", "3x"]


def test_whitening_makes_the_identity(spark):
    x = np.random.default_rng(0).normal(size=(400, 4)) @ np.array([[2, 0, 0, 0], [1, 1, 0, 0], [0, 0, 3, 0], [0, 1, 0, 0.5]]) + 5
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, vec array<double>")
    mu, m = geometry.whitening(geometry.mean_covariance(v), shrink=0.0)
    assert np.allclose(mu, x.mean(axis=0))
    y = np.array([r.vec for r in geometry.transform(v, mu, m, normalise=False).orderBy("id").collect()])
    assert np.allclose(np.cov(y.T), np.eye(4), atol=1e-8)
    assert geometry.shift(geometry.mean_covariance(v), geometry.mean_covariance(v)).first().shared_ok


def test_heads_and_random_vectors(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal([5, 0, 0], 0.1, (20, 3)), rng.normal([0, 5, 0], 0.1, (20, 3))])
    v = spark.createDataFrame([(i, i, r.tolist()) for i, r in enumerate(x)], "entry_id int, slot int, vec array<double>")
    unit = v.select("entry_id", vectors.l2_normalise("vec").alias("vec"))
    same = geometry.head(unit, np.ones((2, 3)), np.zeros((3, 2))).orderBy("entry_id").collect()
    assert np.allclose([r.vec for r in same], [r.vec for r in unit.orderBy("entry_id").collect()])
    r1, r2 = (geometry.random_unit_vectors(v.repartition(n), 8).orderBy("entry_id").collect() for n in (1, 5))
    assert r1 == r2 and all(abs(np.linalg.norm(r.vec) - 1) < 1e-9 for r in r1)


def test_gelu_and_guards(spark):
    x = spark.createDataFrame([(0.0,), (1.0,), (-2.0,), (None,)], "x double").select(numeric.gelu("x").alias("g"), numeric.relu(F.col("x")).alias("r")).collect()
    assert [r.g for r in x[:3]] == pytest.approx([0, 0.8413447, -0.0455003], abs=1e-6) and x[3].g is None


def test_losses(spark):
    s = spark.createDataFrame([(0, 0, 2.0), (0, 1, 1.0)], "qid long, pid long, score double")
    assert training.info_nce(s, spark.createDataFrame([(0, 1)], "qid long, pid long")).first().loss == pytest.approx(math.log(math.e**2 + math.e) - 1)
    p = spark.createDataFrame([(0, 1.0), (0, 1.0), (1, 2.0)], "entry_id int, weight double")
    assert training.flops(p, 2).first().flops == 2.0


def test_adoption_without_a_winner(spark):
    assert decisions.adopt(spark.createDataFrame([("Z", 0.5)], "variant string, rho double"), ["raw", "Z"]).count() == 0


def test_lower_median_differs(spark):
    s = spark.createDataFrame([(0, False, float(v)) for v in (1, 2, 3, 10)] + [(1, True, 1.0)], "decile int, held boolean, v double")
    assert {r.decile: r.target for r in diagnostics.decile_target(s, "v").collect()} == {0: 2.5, 1: 2.5}
    assert {r.decile: r.target for r in diagnostics.decile_target(s, "v", lower=True).collect()} == {0: 2.0, 1: 2.0}


def test_json_of_numpy(tmp_path):
    from postwright.sources import artifacts

    artifacts.save_json(f"{tmp_path}/a.json", {"x": np.float32(0.5), "y": np.arange(3)})
    assert json.load(open(f"{tmp_path}/a.json")) == {"x": 0.5, "y": [0, 1, 2]} and artifacts.tagged("proto", "legal", enc="e5") == "proto_e5_legal"


def test_gelu_head_matches_its_definition(spark):
    rng = np.random.default_rng(1)
    x, w1, w2 = rng.normal(size=(5, 4)), rng.normal(size=(3, 4)), rng.normal(size=(4, 3))
    z = x @ w1.T
    h = x + (z * 0.5 * (1 + np.vectorize(math.erf)(z / math.sqrt(2)))) @ w2.T
    want = h / np.linalg.norm(h, axis=1, keepdims=True)
    got = geometry.head(spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "entry_id int, vec array<double>"), w1, w2).orderBy("entry_id").collect()
    assert np.allclose([r.vec for r in got], want)


@pytest.mark.parametrize("rows", [8_000_000, 0])
def test_pooling_sent_or_joined(spark, monkeypatch, rows):
    """Few similarities are pooled where the texts are, many are joined: the same postings."""
    from postwright.operators import postings

    monkeypatch.setattr(postings, "SENT_ROWS", rows)
    rng = np.random.default_rng(2)
    sims = [(v, e, float(np.round(rng.random(), 2))) for v in range(12) for e in range(30) if rng.random() < 0.5]
    units = [(p, int(rng.integers(14))) for p in range(25) for _ in range(rng.integers(1, 9))]
    s, u = spark.createDataFrame(sims, "vec_id long, entry_id int, sim double"), spark.createDataFrame(units, "pid long, vec_id long")
    best = {}
    for p, v in units:
        for w, e, x in sims:
            if w == v:
                best[p, e] = max(best.get((p, e), 0), x)
    assert {(r.pid, r.entry_id): r.sim for r in postings.max_pool(u, s).collect()} == best
    want = set()
    for p in {p for p, _ in units}:
        own = sorted((-round(x - 0.3, 8), e) for (q, e), x in best.items() if q == p and x > 0.3)[:4]
        want |= {(p, e, -w, k) for k, (w, e) in enumerate(own)}
    assert {(r.pid, r.entry_id, r.weight, r["rank"]) for r in postings.pooled_postings(u, s, 0.3, 4).collect()} == want


def test_phrases_anywhere_in_blocks(spark):
    from postwright.operators import tokens

    texts = [(1, "xabcy abc"), (2, "ab c"), (3, None), (4, ""), (5, "éabcé b"), (5, "b")]
    phrases = [(7, "abc"), (8, "b"), (9, ""), (10, None), (11, "abc")]
    t, p = spark.createDataFrame(texts, "pid long, text string"), spark.createDataFrame(phrases, "qid long, phrase string")
    for block in (1, 1000):
        got = sorted(tuple(r) for r in tokens.containing(t, p, "pid", "qid", block_bytes=block).collect())
        assert got == sorted((i, q) for i, x in texts for q, y in phrases if x and y and y in x)


@pytest.mark.parametrize("rows", [150, 60])
def test_pooling_by_levels_and_blocks(spark, monkeypatch, rows):
    """More similarities than are sent at once: texts that are whole at a level leave, the others go on to all; nothing is joined or left out."""
    from postwright.operators import postings

    rng = np.random.default_rng(5)
    sims = [(v, e, float(np.round(rng.random() ** 2, 8))) for v in range(14) for e in range(40) if rng.random() < 0.6]
    texts = [(p, sorted({int(x) for x in rng.integers(16, size=rng.integers(1, 9))})) for p in range(40)] + [(40, []), (41, [99])]
    s, u = spark.createDataFrame(sims, "vec_id long, entry_id int, sim double"), spark.createDataFrame(texts, "pid long, keys array<long>")
    by = {p: {} for p, _ in texts}
    for p, own in texts:
        for v, e, x in sims:
            if v in own:
                by[p][e] = max(by[p].get(e, 0.0), x)
    monkeypatch.setattr(postings, "SENT_ROWS", rows)
    monkeypatch.setattr(postings, "POOL_CELLS", 64)
    monkeypatch.setattr(postings, "HELD_COUNTS", 1000)
    plain = lambda df: {tuple(r) for r in df.collect()}
    joined = []
    monkeypatch.setattr(postings, "sparsify", lambda *a: joined.append(a))
    for saturation in ("none", "log1p"):
        want = set()
        for p, best in by.items():
            weigh = (lambda x: round(math.log1p(x - 0.1), 8)) if saturation == "log1p" else (lambda x: round(x - 0.1, 8))
            own = sorted((-weigh(x), e) for e, x in best.items() if x > 0.1)[:5]
            want |= {(p, e, -w, k) for k, (w, e) in enumerate(own)}
        assert plain(postings.pooled_postings(u, s, 0.1, 5, saturation=saturation)) == want
    assert not joined
    sums = {r.pid: (r.n, round(r.total, 6)) for r in postings.pooled_sums(u, s).collect()}
    assert sums == {p: (len(best), round(sum(best.values()), 6)) for p, best in by.items() if best}
    profile = postings.max_pool(u, s)
    assert plain(profile) == {(p, e, x) for p, best in by.items() for e, x in best.items()}
    rounded = profile.withColumn("s", F.round("sim", 2))
    assert plain(postings.pooled_counts(u, s, 2)) == plain(rounded.groupBy("s").count())
    assert plain(postings.pooled_counts(u, s, 2, by_entry=True)) == plain(rounded.groupBy("entry_id", "s").count())


def test_every_resample_draws_as_many_rows_as_there_are(spark):
    """Values that are powers of a base count the draws of each row: a resample of n rows has n."""
    from postwright.operators.metrics import drawn_means

    rows = spark.createDataFrame([(q, float(20**k)) for k, q in enumerate((3, 5, 8, 11))], "qid long, m double")
    for r in drawn_means(rows, ["m"], 30, "boot").collect():
        digits, total = [], round(r.m * 4)
        while total:
            digits.append(total % 20)
            total //= 20
        assert sum(digits) == 4
    got = metrics.bootstrap_interval(rows.select("qid", F.lit(1.0).alias("m")), "m", 30).first()
    assert (got["mean"], got.lo, got.hi) == (1.0, 1.0, 1.0)


@pytest.mark.parametrize("saturation", ["none", "log1p"])
def test_postings_rest_on_a_few_similarities_of_each_state(spark, monkeypatch, saturation):
    """Ties, few values and several blocks: the postings are those of all similarities, and a state sends about as many as are kept."""
    from postwright.operators import postings

    rng = np.random.default_rng(8)
    vecs = lambda n: [(k, np.round(rng.normal(size=4) / 3, 1).tolist()) for k in range(n)]
    states, entries = spark.createDataFrame(vecs(30), "vec_id long, state array<double>"), spark.createDataFrame(vecs(200), "entry_id int, vec array<double>")
    texts = spark.createDataFrame([(p, sorted({int(x) for x in rng.integers(32, size=rng.integers(0, 7))})) for p in range(50)], "pid long, keys array<long>")
    every = postings.similarities(states, entries, 4, floor=0.05)
    few = postings.strongest(states, entries, 4, 6, 0.05, saturation)
    plain = lambda df: sorted(tuple(r) for r in df.collect())
    want = plain(postings.pooled_postings(texts, every, 0.05, 6, saturation=saturation))
    assert plain(postings.pooled_postings(texts, few, 0.05, 6, saturation=saturation)) == want
    assert few.count() < every.where("sim > 0.05").count() / 3
    only = spark.createDataFrame([(e,) for e in (3, 5, 5, 60, 77, 999) + tuple(range(100, 160))], "entry_id int")
    own = [r for r in want if r[1] in {x.entry_id for x in only.collect()}]
    assert own and plain(postings.pooled_postings(texts, few, 0.05, 6, saturation=saturation, only=only)) == own
    monkeypatch.setattr(postings, "SENT_ROWS", 60)
    assert plain(postings.pooled_postings(texts, every, 0.05, 6, saturation=saturation, only=only)) == own
    monkeypatch.setattr(postings, "BLOCK_BYTES", 8 * 4 * 50)
    assert plain(postings.pooled_postings(texts, postings.strongest(states, entries, 4, 6, 0.05, saturation), 0.05, 6, saturation=saturation)) == want


def test_bounded_sample_is_the_whole_sample(spark, monkeypatch):
    """Entries of few and of many passages, pairs that are counted too often, keys sent or joined: the sample of all rows, from few of them."""
    from postwright.operators import vocabulary

    rows = spark.range(4000).selectExpr("id AS pid", "explode(filter(array(0, 1, 2, 3), e -> id % (e * e * 40 + 1) = 0)) AS entry_id", "id % 7 AS pos")
    rows = rows.union(rows.where("pid % 2 = 0 AND entry_id = 0").withColumn("pos", F.lit(9).cast("long"))).select(F.col("entry_id").cast("int").alias("entry_id"), "pid", "pos")
    want = sorted(tuple(r) for r in vocabulary.occurrence_sample(rows, most=20).collect())
    for repeats, keys in ((1, 100), (60, 100), (1, 1)):
        monkeypatch.setattr(vocabulary, "SENT_KEYS", keys)
        pairs = rows.select("entry_id", "pid").distinct().withColumn("x", F.explode(F.sequence(F.lit(1), F.lit(repeats)))).drop("x")
        slots, near = vocabulary.bounded_sample(pairs, rows, most=20)
        assert sorted(tuple(r) for r in slots.collect()) == want
        whole = spark.createDataFrame([r for r in want], "entry_id int, pid long, slot int").join(rows, ["entry_id", "pid"]).count()
        assert near.join(slots, ["entry_id", "pid"]).count() == whole
        assert near.where("entry_id = 0").count() < 600 or repeats == 60


def test_successions_and_runs_inside_the_row(spark):
    """As by windows over a row a token, without an exchange."""
    from postwright.operators import tokens

    texts = [(1, "The the cat, the CAT sat"), (2, ""), (3, None), (4, "one"), (5, "a b a b a"), (6, "aa bb c dd, ee! ff")]
    p = spark.createDataFrame(texts, "pid long, text string")
    plain = lambda df: sorted(tuple(r) for r in df.collect())
    t = tokens.tokens(p)
    got = tokens.successions(p)
    assert plain(got) == plain(tokens.adjacent(t).where("next IS NOT NULL").select("pid", "pos", "word", "next"))
    assert plain(tokens.followed_words(p)) == plain(got.select("pid", "word").distinct())
    i = tokens.islands(t.withColumn("l", F.length("word")), "pid", "pos", "l").groupBy("pid", "island").agg(F.count("*").alias("c"))
    runs = tokens.run_summary(p, F.length)
    assert plain(runs) == plain(i.groupBy("pid").agg(F.max("island") + 1, F.max("c")))
    for df in (got, runs, tokens.followed_words(p)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan and "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_means_of_states_in_blocks(spark, monkeypatch):
    from postwright.operators import encoder

    rng = np.random.default_rng(4)
    matrix = rng.normal(size=(40, 6))
    table = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(matrix)], "vec_id long, embedding array<double>")
    counted = [(e, int(v), int(rng.integers(1, 9))) for e in range(9) for v in rng.choice(40, size=rng.integers(1, 20), replace=False)]
    c = spark.createDataFrame(counted, "entry_id int, vec_id long, n long")
    want = {e: np.average([matrix[v] for x, v, _ in counted if x == e], axis=0, weights=[n for x, _, n in counted if x == e]) for e in range(9)}
    e = encoder.LookupEncoder(encoder.EncoderSpec("lookup", 6), table, 40)
    for size in (64 << 20, 8 * 6 * 15):
        monkeypatch.setattr(encoder, "SENT_BYTES", size)
        got = {r.entry_id: r.vec for r in e.means(c, "entry_id").collect()}
        assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
