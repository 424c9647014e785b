import random

import corpus_pipeline
import numpy as np

from postwright.llm import near_copies


def grams(text):
    w = (text or "").encode().lower().split()
    k = min(5, len(w))
    return {tuple(w[q : q + k]) for q in range(len(w) - k + 1)} if w else set()


def brute_kept(docs):
    """Ids that stay: the smallest of each component of pairs of similarity 0.8 or more."""
    sets, parent = [grams(t) for _, t in docs], list(range(len(docs)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            if len(x & sets[j]) >= 0.8 * len(x | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {docs[i][0] for i in range(len(docs)) if find(i) == i}


def edited(seed=11):
    """Texts in groups, with copies of similarities from about 0.6 to 1, chains, short texts and texts without words."""
    rng = random.Random(seed)
    texts = [None, "", "  ", "one", "ONE", "one two", "one two three", "a b c d e", "a b c d f"]
    for g in range(12):
        base = [f"v{rng.randrange(3000)}" for _ in range(rng.choice([30, 80, 200]))]
        for _ in range(12):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = f"n{rng.randrange(9000)}"
            texts.append(" ".join(w))
            base = w if g % 3 == 0 else base
    return list(enumerate(texts))


def test_stage_drops_all_copies_of_similarity_and_no_others(spark):
    docs = edited()
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' AS key", "'y' AS cell")
    kept = corpus_pipeline.drop_near_copies(spark, d, "")
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == brute_kept(docs)
    assert corpus_pipeline.drop_near_copies(spark, d.where("false"), "").count() == 0


def test_repeated_and_null_ids(spark):
    copy = " ".join(f"w{k}" for k in range(40))
    rows = [(1, copy), (2, copy + " x"), (2, "a text of its own with the same id"), (None, copy + " y"), (None, "another text without any id at all")]
    got = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert {r.text for r in got} == {copy, rows[2][1], rows[4][1]}


def test_bands_of_pairs_at_the_threshold():
    """Of 2,000 pairs of similarity 0.8 all share a band."""
    rng = np.random.default_rng(2)
    for _ in range(2000):
        own = rng.integers(0, 1 << 63, 100, dtype=np.uint64)
        assert (near_copies.bands(near_copies.least_hashes(own)) == near_copies.bands(near_copies.least_hashes(own[:80]))).any()


def test_sketches_count_differing_values(spark):
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(50):
        x, y = near_copies.least_hashes(a := rng.integers(0, 1 << 63, 60, dtype=np.uint64)), near_copies.least_hashes(np.concatenate([a[:50], rng.integers(0, 1 << 63, 10, dtype=np.uint64)]))
        mixed = [(v * near_copies.MULTIPLIER) >> np.uint64(60) for v in (x, y)]
        rows.append((near_copies.sketch(x).view(np.int64).tolist(), near_copies.sketch(y).view(np.int64).tolist(), int((mixed[0] != mixed[1]).sum())))
    got = spark.createDataFrame(rows, "x array<long>, y array<long>, n int").select("n", near_copies.differing("x", "y").alias("d")).collect()
    assert all(r.n == r.d for r in got)


def test_many_members_of_one_pivot(spark, monkeypatch):
    """A group dealt to several tasks keeps every link."""
    monkeypatch.setattr(near_copies, "SHARE", 3)
    base = [f"w{k}" for k in range(100)]
    docs = [(k, " ".join([*base[: k % 50], f"x{k}", *base[k % 50 + 1 :]])) for k in range(40)]
    kept = near_copies.drop_near_copies(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id for r in kept} == brute_kept(docs)


def test_a_set_is_joined_once_and_not_once_a_cell(spark):
    rows = [(k, [c for c in range(32) if k < 20 or c == k], 5 + k, [k]) for k in range(24)]
    unique = spark.createDataFrame(rows, "key long, cells array<long>, size int, sketch array<long>")
    members = near_copies._members(unique)
    n = {c: sum(c in own for _, own, *_ in rows) for c in range(32)}
    want = {(c, k, sum(n[x] for x in own if n[x] > 1), size, tuple(sketch), tuple(own)) for k, own, size, sketch in rows for c in own if n[c] > 1}
    assert {(r.cell, r.key, r.central, r["size"], tuple(r.sketch), tuple(r.cells)) for r in members.collect()} == want
    plan = members._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode(own") < plan.index("Join Inner, (key")


def test_parity_maps_rule_out_no_similar_sets(spark):
    rng = np.random.default_rng(5)
    rows = []
    for n in (1, 4, 60, 150, 900, 4000):
        for edits in (0, 1, n // 10, n // 5):
            x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            y = np.unique(np.concatenate([x[edits:], rng.integers(0, 1 << 63, edits // 2, dtype=np.uint64)]))
            maps = [[0] * near_copies.SKETCH + near_copies.parity(v).view(np.int64).tolist() for v in (x, y)]
            rows.append((*maps, len(x), len(y), len(np.setxor1d(x, y)), near_copies.similarity(x, y) >= 0.8))
    df = spark.createDataFrame(rows, "x array<long>, y array<long>, nx int, ny int, apart int, similar boolean")
    got = df.select("apart", "similar", near_copies.apart("x", "y").alias("seen"), near_copies.most_apart(0.8, "nx", "ny").alias("most")).collect()
    assert all(r.seen <= r.apart and r.similar == (r.apart <= r.most) for r in got)
    assert any(r.seen > r.most for r in got)


def test_sets_just_below_the_threshold_are_not_compared_pair_by_pair(spark, monkeypatch):
    """Each text has 3 of 30 changes, so that no shingle is a text's own and most pairs lie between 0.6 and 0.8."""
    rng, seen, real = random.Random(7), [], near_copies._verified
    monkeypatch.setattr(near_copies, "_verified", lambda pairs, *a: seen.append(pairs.count()) or real(pairs, *a))
    docs = []
    for k in range(120):
        w = [f"w{q}" for q in range(150)]
        for q in rng.sample(range(30), 3):
            w[5 * q] = f"x{q}"
        docs.append((k, " ".join(w)))
    kept = near_copies.drop_near_copies(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id for r in kept} == brute_kept(docs)
    assert sum(seen) <= 3 * len(docs), seen
