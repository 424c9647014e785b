import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from postwright.llm import divergence


def terms(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if c.isascii() and not c.isalpha():
            out += [word] * bool(word)
            word = ""
        else:
            word += c.lower() if c.isascii() else c
    return out


def plain(rows, least_docs=30, top=50):
    docs = [(lang or "", source or "", terms(text)) for text, lang, source in rows]
    df, counts, langs, groups = Counter(), Counter(), Counter(), sorted({d[:2] for d in docs})
    for lang, source, ts in docs:
        for t in ts:
            counts[lang, source, t] += 1
            langs[lang, t] += 1
        for t in set(ts):
            df[lang, t] += 1
    kept = {lang: [t for (l, t), n in df.items() if l == lang and n >= least_docs] for lang, _ in groups}

    def shares(count, lang):
        n, v = sum(count(t) for t in kept[lang]), len(kept[lang])
        return {t: 1 + 10**9 * (count(t) + 5) // (n + 5 * v) for t in kept[lang]}

    p = {(lang, s): shares(lambda t, lang=lang, s=s: counts[lang, s, t], lang) for lang, s in groups}
    q = {lang: shares(lambda t, lang=lang: langs[lang, t], lang) for lang in kept}
    out = []
    for lang, s in groups:
        own = p[lang, s]
        pair = [(-sum(abs(own[t] - p[lang, o][t]) for t in own), o) for l, o in groups if l == lang and o != s]
        term = [(q[lang][t] - own[t], t) for t in own if counts[lang, s, t] and own[t] > q[lang][t]]
        key = lambda x: (x[0], x[1].encode())
        out += [(lang, s, "pair", o, -v, k) for k, (v, o) in enumerate(sorted(pair, key=key), 1)]
        out += [(lang, s, "term", t, -v, k) for k, (v, t) in enumerate(sorted(term, key=key)[:top], 1)]
    return sorted(out)


def corpus(seed, n=400):
    """Sources of very unlike sizes: shares of zero differ, so that corrections of all kinds occur."""
    rng = random.Random(seed)
    words = [f"w{c}{d}" for c in "abcdefgh" for d in "abcdefgh"] + ["Éa", "É", "ünï"]
    rows = []
    for _ in range(n):
        s = min(int(rng.expovariate(0.8)), 7)
        rows.append((" ".join(rng.choice(words[: 8 * (s + 1)]).upper() if rng.random() < 0.2 else rng.choice(words) for _ in range(rng.randint(0, 6 + 20 * s))), rng.choice(["en", "en", "en", "de", None]), f"s{s}"))
    return rows


def table(spark, rows):
    return spark.createDataFrame(rows, "text string, lang string, source string")


def found(df, **settings):
    return sorted(tuple(r) for r in divergence.divergence(df, **settings).collect())


@pytest.mark.parametrize(("held", "least"), [(400_000, 30), (50, 3), (50, 60)])
def test_audit_equals_dense_sums(spark, monkeypatch, held, least):
    """Also with counts sent in many parts, and with languages that keep no term."""
    monkeypatch.setattr(divergence, "HELD", held)
    rows = corpus(held + least)
    assert found(table(spark, rows), least_docs=least) == plain(rows, least)


def test_odd_rows(spark):
    """Groups without terms, null names beside empty ones, equal values, repeated rows, a long text, clashing names."""
    rows = [("same words here", "en", f"s{k % 3}") for k in range(60)] + [(None, "en", None), ("", "en", ""), ("1 2 3", "en", "digits"), ("x", None, "only"), ("y", "", None)] + [("long a1b " * 200_000, "en", "s0")] * 2
    df = table(spark, rows)
    odd = df.withColumns({c: F.lit("x") for c in ("term", "n", "docs", "p", "zero", "v", "item", "part", "rank", "salt", "own")})
    assert found(odd, least_docs=30) == plain(rows, 30)
    assert divergence.divergence(df.where("false")).count() == 0


def test_shares_are_exact_beyond_64_bits(spark):
    n = 9 * 10**12
    df = spark.createDataFrame([(n, 3 * n, 7)], "c long, n long, v long")
    assert df.select(divergence.share(F.col("c"), F.col("n"), F.col("v"))).first()[0] == 1 + 10**9 * (n + 5) // (3 * n + 35)
