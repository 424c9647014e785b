import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from postwright.llm import ngram_join


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def grams(text, width=4):
    w = lower(text).encode().split()
    k = min(width, len(w))
    return {tuple(w[q : q + k]) for q in range(len(w) - k + 1)} if w else set()


def brute(docs, percent=85):
    """(id, size, component) by comparing all pairs."""
    sets, parent = [grams(t) for _, t in docs], list(range(len(docs)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            if x and docs[i][0] is not None and docs[j][0] is not None and sets[j] and 100 * len(x & sets[j]) >= percent * len(x | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(docs)), key=str)


def found(df, **settings):
    return sorted((tuple(r) for r in ngram_join.ngram_components(df, **settings).collect()), key=str)


def edited(seed, groups=14, copies=14):
    """Families of copies with similarities around the threshold, chains, a passage that many share, short texts, texts without words."""
    rng = random.Random(seed)
    passage = [f"p{k}" for k in range(60)]
    texts = [None, "", " \t ", "one", "ONE", "one two", "one two three", "a b c d", "a b c d e", "A b c d", "x" * 50]
    for g in range(groups):
        base = [f"v{rng.randrange(4000)}" for _ in range(rng.choice([12, 40, 90, 250, 600]))] + passage * (g % 2)
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 40))):
                w[rng.randrange(len(w))] = f"n{rng.randrange(9000)}"
            texts.append(" ".join(w[: rng.randint(len(w) * 9 // 10, len(w))]))
            base = w if g % 3 == 0 else base
    for k in range(30):  # passages with few words of their own: near the threshold, and many
        texts.append(" ".join(passage + [f"u{k}-{i}" for i in range(k % 12)]))
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    return list(zip(ids, texts, strict=True))


@pytest.mark.parametrize(("seed", "group", "share"), [(1, 64, 128), (2, 3, 2)])
def test_components_equal_all_pairs(spark, monkeypatch, seed, group, share):
    """Also with small groups, and queries of a group dealt to several tasks."""
    monkeypatch.setattr(ngram_join.matrix_links, "__defaults__", (85, group))
    monkeypatch.setattr(ngram_join.opened, "__defaults__", (85, share))
    docs = edited(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("key", "size", "token", "gid", "component", "least", "first")})
    assert found(df) == brute(docs)


def test_matrix_alone_loses_nothing(spark, monkeypatch):
    """Without the links of the near copies the matrix has to find every link."""
    monkeypatch.setattr(ngram_join, "near_copies", lambda sets, percent: sets.select(F.col("key").alias("a"), F.col("key").alias("b")).where("false"))
    docs = edited(3, groups=9)
    assert found(spark.createDataFrame(docs, "doc_id long, text string")) == brute(docs)


def test_odd_rows(spark, odd_docs, no_docs):
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert found(odd_docs) == brute(docs)
    assert ngram_join.ngram_components(no_docs).count() == 0
    same = [(1, "a b c d e f"), (1, "another text with the same id"), (2, "A B C D E F"), (2, "a b c d e f"), (None, "a b c d e f")]
    assert found(spark.createDataFrame(same, "doc_id long, text string")) == sorted([(1, 3, 1), (1, 3, 1), (2, 3, 1), (2, 3, 1), (None, 3, None)], key=str)


def test_threshold_is_exact(spark):
    """85 of 100 shingles links, 84 of 100 does not; sizes lie on both sides of the first look's limits."""
    for n in (103, 4003):
        words = [f"w{k}" for k in range(n)]
        part = (n - 3) * 85 // 100 + 3
        docs = [(1, " ".join(words)), (2, " ".join(words[:part])), (3, " ".join(x + "x" for x in words)), (4, " ".join(x + "x" for x in words[: part - 1]))]
        assert [c for *_, c in found(spark.createDataFrame(docs, "doc_id long, text string"))] == [1, 1, 3, 4]


def test_word_hashes_by_spans():
    """Cut into spans, words and places are the same; a word longer than a span is hashed whole."""
    rng = random.Random(4)
    text = b"".join(rng.choice([b" ", b"\t", b"ab", b"C", b"\xc3\xa9", b"x" * 40]) for _ in range(3000))
    whole, starts = ngram_join.WordHashes()(text)
    cut, places = ngram_join.WordHashes(span=64)(text)
    words = text.lower().split()
    assert len(words) == len(whole) and (starts == places).all()
    assert [text.lower()[s : s + len(w)] for s, w in zip(starts, words, strict=True)] == words
    by = {}
    for w, a, b in zip(words, whole, cut, strict=True):
        assert by.setdefault(w, (a, b)) == (a, b) and (a == b or len(w) > 64)
    assert len({a for a, _ in by.values()}) == len(by)


def test_group_is_closed_by_its_bound():
    sets = [np.arange(10, dtype=np.uint64), np.arange(5, 15, dtype=np.uint64)]
    g = ngram_join.Group([1, 2], [1, 2], sets)
    assert g.partners(np.arange(10, dtype=np.uint64), 9, 85).tolist() == [1]
    assert g.partners(np.arange(10, dtype=np.uint64), 1, 85).tolist() == []
    assert g.partners(np.arange(8, 24, dtype=np.uint64), 9, 85).tolist() == []
