import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from postwright.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def lower(t):
    return t if t is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def leaf(d, text):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (d["doc_id"], d["source"], d["lang"], d["n_chars"], text)))


def levels(nodes, fanout):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][k : k + fanout]) for k in range(0, len(out[-1]), fanout)])
    return out


def way(tree, i, fanout):
    for nodes in tree[:-1]:
        a = i // fanout * fanout
        yield "".join(nodes[a:i]), "".join(nodes[i + 1 : a + fanout])
        i //= fanout


def plain(docs, fanout=8, tampered=3):
    """The manifest by lists."""
    parts = {}
    for d in docs:
        parts.setdefault(d["lang"], []).append(d)
    order = sorted(parts, key=lambda x: (x is not None, (x or "").encode()))
    for own in parts.values():
        own.sort(key=lambda d: (d["doc_id"] is not None, d["doc_id"] or 0, leaf(d, d["text"])))
    trees = [levels([leaf(d, d["text"]) for d in parts[x]], fanout) for x in order]
    upper, out = levels([t[-1][0] for t in trees], fanout), []
    for k, x in enumerate(order):
        for i, d in enumerate(parts[x]):
            path, own = [*way(trees[k], i, fanout), *way(upper, k, fanout)], leaf(d, d["text"])
            crc = zlib.crc32(("" if d["doc_id"] is None else str(d["doc_id"])).encode())
            folded = leaf(d, lower(d["text"])) if crc % tampered == 0 else own
            for a, b in path:
                folded = h(a, folded, b)
            out.append((d["doc_id"], own, trees[k][-1][0], upper[-1][0], h("".join(a + b for a, b in path)), folded, folded == upper[-1][0]))
    return sorted(out, key=str)


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def found(df, **settings):
    return sorted((tuple(r) for r in merkle.manifest(df, **settings).collect()), key=str)


@pytest.mark.parametrize("fanout", [8, 2])
def test_manifest_equals_lists(spark, fanout):
    """A hot language, a language of one row, a null and an empty one, null and repeated ids, repeated rows, nulls in every column."""
    rng = random.Random(fanout)
    rows = [(k, f"Text {rng.random()} ÄÖ", "en" if k % 3 else "dé", f"s{k % 4}", k) for k in range(150)]
    rows += [(500, "Alone", "xx", None, None), (None, "NO id", None, "", 3), (None, None, None, None, None), (None, "NO id", None, "", 3), (7, "other Text", "en", "s", 1), (7, "other Text", "en", "s", 1), (8, "", "", "s", 0)]
    df = table(spark, rows)
    assert found(df, fanout=fanout) == plain([r.asDict() for r in df.collect()], fanout)


def test_clashing_columns_long_texts_and_more_languages_than_a_run(spark):
    rows = [(k, "Long " * 300_000 if k == 3 else f"Ab {k}", f"l{k % 11}", "s", k) for k in range(40)]
    df = table(spark, rows)
    odd = df.withColumns({c: F.lit("x") for c in ("part", "leaf", "row", "i", "n", "h", "kids", "path", "task", "root", "at", "name")})
    assert found(odd) == plain([r.asDict() for r in df.collect()])


def test_one_row_and_none(spark):
    (r,) = merkle.manifest(table(spark, [(5, "A text", "en", "s", 6)])).collect()
    assert r.leaf == r.subroot == r.root and r.proof_sha256 == h("")
    assert merkle.manifest(table(spark, [])).count() == 0


def test_tampering_shows_unless_nothing_changes(spark):
    rows = [(k, None if k % 5 == 0 else "lower" if k % 5 == 1 else "Upper", "en", "s", 1) for k in range(60)]
    got = {r.doc_id: r.verified for r in merkle.manifest(table(spark, rows)).collect()}
    assert got == {k: not (zlib.crc32(str(k).encode()) % 3 == 0 and t == "Upper") for k, t, *_ in rows}
