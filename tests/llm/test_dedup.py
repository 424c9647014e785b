import random

import numpy as np
import pytest
import xxhash

from postwright.llm import exact_dedup, simhash
from postwright.llm import components
from postwright.llm.components import connected_components


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


@pytest.mark.parametrize("bits", [64, 4])
def test_exact_matches_brute_force(spark, odd_docs, bits):
    """With four-bit identifiers nearly all chunks collide, and the ordinals must keep them apart."""
    rng = random.Random(bits)
    rows = [(100 + i, "".join(rng.choice("ab c") for _ in range(rng.choice([0, 5, 40])))) for i in range(60)]
    docs = odd_docs.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    got = exact_dedup.exact_duplicates(docs, id_bits=bits, smallest=4, largest=9).collect()
    groups = {}
    for r in docs.collect():
        groups.setdefault(lower(r.text), []).append(r.doc_id)
    want = sorted((d, max((x for x in g if x is not None), default=None), len(g)) for g in groups.values() for d in g if d is not None)
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in got if r.doc_id is not None) == want
    assert all(r.kept == (r.doc_id is not None and r.doc_id == r.keep_id) for r in got)
    assert len(got) == docs.count()


def test_chunks_make_up_the_text(spark):
    import re

    rng = random.Random(0)
    text = "".join(rng.choice("ab c.\n") for _ in range(5000))
    assert "".join(re.findall(exact_dedup.chunk_pattern(50, 400), text)) == text


def test_drop_exact(spark, no_docs):
    docs = spark.createDataFrame([(1, "A b"), (2, "a B"), (3, "c"), (4, None), (5, "")], "doc_id long, text string")
    assert sorted(r.doc_id for r in exact_dedup.drop_exact_duplicates(docs).collect()) == [2, 3, 5]
    assert exact_dedup.exact_duplicates(no_docs).count() == 0


def test_drop_exact_with_repeated_and_null_ids(spark):
    rows = [(1, "copy"), (2, "COPY"), (1, "a text of its own"), (None, "copy"), (None, "none has an id"), (None, "None has an id"), (7, "twice"), (7, "twice"), (None, "alone")]
    d = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS keep_id")
    got = exact_dedup.drop_exact_duplicates(d)
    assert got.columns == d.columns
    assert sorted((str(r.doc_id), r.text.lower()) for r in got.collect()) == [("1", "a text of its own"), ("2", "copy"), ("7", "twice"), ("None", "alone"), ("None", "none has an id")]


def slow_fingerprint(text):
    words = lower(text).encode().split()
    grams = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [b" ".join(words)] * bool(words)
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum((sum(x >> b & 1 for x in h) * 2 > len(h)) << b for b in range(64)) if h else 0


def test_fingerprints(spark, odd_docs):
    got = {(r.doc_id, r.fingerprint) for r in simhash.near_duplicates(odd_docs).collect()}
    assert got == {(r.doc_id, f"{slow_fingerprint(r.text):016x}") for r in odd_docs.collect()}


def brute_components(prints):
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, x in enumerate(prints):
        for j in range(i):
            if bin(x ^ prints[j]).count("1") <= 2:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


@pytest.mark.parametrize("hot", [4096, 6])
def test_links_lose_nothing(spark, hot):
    rng = random.Random(5)
    prints = set()
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(20):
            y = x
            for _ in range(rng.randint(0, 4)):
                y ^= 1 << rng.randrange(64)
            prints.add(y)
            x = y if rng.random() < 0.3 else x
    prints = sorted(prints)
    unique = spark.createDataFrame([(simhash.signed(p), i) for i, p in enumerate(prints)], "fp long, rep long")
    found = {r.node: r.component for r in connected_components(simhash.near_links(unique, hot=hot)).collect()}
    assert [found.get(i, i) for i in range(len(prints))] == brute_components(prints)


@pytest.mark.parametrize("rows", ["2", "3"])
def test_hot_cells_across_batches_lose_nothing(spark, rows):
    """Pairs that differ in two axis groups share one grid only, whose cells here are hot and end inside a batch."""
    rng = random.Random(7)
    prints = set()
    for _ in range(3):
        base = rng.getrandbits(36)
        for _ in range(20):
            x = base | rng.getrandbits(28) << 36
            prints |= {x, x ^ 1 << rng.randrange(36, 50) ^ 1 << rng.randrange(50, 64)}
    prints = sorted(prints)
    unique = spark.createDataFrame([(simhash.signed(p), i) for i, p in enumerate(prints)], "fp long, rep long")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        found = {r.node: r.component for r in connected_components(simhash.near_links(unique, hot=6)).collect()}
    finally:
        spark.conf.set(key, before)
    assert [found.get(i, i) for i in range(len(prints))] == brute_components(prints)


def test_lower_bound_and_exact_distance():
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 1 << 63, (2, 500), dtype=np.uint64)
    want = [sum(abs(bin(int(a) >> k & 3).count("1") - bin(int(b) >> k & 3).count("1")) for k in range(0, 64, 2)) for a, b in zip(x, y, strict=True)]
    assert simhash.manhattan(x, y).tolist() == want
    assert (simhash.manhattan(x, y) <= np.bitwise_count(x ^ y)).all()


def test_near_components_of_odd_rows(spark, odd_docs, no_docs):
    rows = simhash.near_duplicates(odd_docs).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == odd_docs.count() and by[None].component_id is None
    assert by[1].component_id == by[2].component_id == by[8].component_id == 1
    assert by[3].component_id == by[4].component_id == by[5].component_id == 3
    assert simhash.near_duplicates(no_docs).count() == 0


@pytest.mark.parametrize("one_task", [200_000, 0])
def test_long_chain_is_one_component(spark, monkeypatch, one_task):
    monkeypatch.setattr(components, "ONE_TASK", one_task)
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in connected_components(links).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[101] == 100
