import random
from collections import Counter

import numpy as np
import pytest

from postwright.llm import decontaminate, license_scan, url_filter

LICENSED = [
    ("Released under the MIT License.", ["mit"], 1, 3, 3), ("licensed under CC BY-NC 4.0, and cc-by again", ["cc-by"], 2, 2, 8), ("gnu general public license gnu general public license", ["gpl"], 2, 0, 4),
    ("GNU lesser general public license", [], 0, None, None), ("no such thing", [], 0, None, None), ("", [], 0, None, None), (None, [], 0, None, None), ("the mit\n license's Apache_License", ["apache", "mit"], 2, 1, 4),
]


def brute_places(text):
    words = license_scan.words_of((text or "").encode())
    found = []
    for phrase, label in license_scan.BASE.items():
        p = phrase.encode().split()
        found += [(k, label) for k in range(len(words) - len(p) + 1) if words[k : k + len(p)] == p]
    return len(words), sorted(found)


@pytest.mark.parametrize(("text", "labels", "n", "first", "last"), LICENSED)
def test_base_places(text, labels, n, first, last):
    got = license_scan.Scanner().scan(None if text is None else text.encode())
    assert got[:2] == brute_places(text)
    assert sorted({x for _, x in got[1]}) == labels and len(got[1]) == n
    assert (got[1][0][0], got[1][-1][0]) == (first, last) if n else first is None


def test_rules_are_many_and_ordered():
    rules = license_scan.rules()
    assert len(rules) >= 300 and [r.priority for r in rules] == list(range(len(rules)))
    assert all(r.gates for r in rules)


def test_gates_miss_nothing():
    """Every rule with all rules run: the gates leave the detections as they are."""
    s = license_scan.Scanner()
    texts = ["licensed under the apache license version 2 0 and cc by nc sa 4 0", "permission is hereby granted free of charge to any person obtaining a copy", "spdx license identifier mit license or later",
             "all rights reserved copyright c 2020 2021", "the eclipse public license v2 0 with classpath exception", "unauthorized copying of this file is prohibited"]
    for t in texts:
        line = f" {t} ".encode()
        every = [(m.start(), m.end(), r) for r in s.rules for m in r.regex.finditer(line)]
        want = [(line.count(b" ", 0, a) - 1, line.count(b" ", 0, b), r) for a, b, r in license_scan.suppress(every)]
        assert s.scan(t.encode())[2] == want and want


NOTICES = [
    ("SPDX-License-Identifier: MIT", "mit"), ("// SPDX-License-Identifier: GPL-3.0-only", "gpl"), ("# SPDX-License-Identifier: GPL-2.0-or-later", "gpl"), ("SPDX-License-Identifier: BSD-3-Clause", "bsd-3-clause"),
    ("/* SPDX-License-Identifier: ISC */", "isc"), ("SPDX-License-Identifier: Zlib", "zlib"), ("SPDX-License-Identifier: Apache-2.0", "apache"), ("SPDX-License-Identifier: LGPL-2.1-or-later", "lgpl"),
    ("SPDX-License-Identifier: AGPL-3.0-only", "agpl"), ("SPDX-License-Identifier: MPL-2.0", "mpl"), ("SPDX-License-Identifier: EPL-2.0", "epl"), ("SPDX-License-Identifier: CC0-1.0", "cc0"),
    ("SPDX-License-Identifier: BSL-1.0", "boost"), ("SPDX-License-Identifier: 0BSD", "0bsd"), ("SPDX-License-Identifier: Unlicense", "unlicense"), ("SPDX-License-Identifier: CC-BY-SA-4.0", "cc-by-sa"),
    ("SPDX-License-Identifier: Apache-2.0 OR MIT", "apache,mit"), ("Licensed under the GPL v3", "gpl"), ("released under GPLv2 or later", "gpl"), ("licensed under the MIT", "mit"), ("License: MIT", "mit"), ("License: BSD", "bsd"),
    ("Distributed under the terms of the LGPL version 2.1", "lgpl"), ("available under the AGPLv3", "agpl"), ("This project is licensed under Apache 2.0", "apache"), ("Licensed under the ISC License", "isc"), ("released under the zlib license", "zlib"),
    ("Licensed under the Mozilla Public License 2.0", "mpl"), ("licensed under MPL 2.0", "mpl"), ("published under the Eclipse Public License v2.0", "epl"), ("Licensed under the EUPL-1.2", "eupl"), ("Distributed under the Boost Software License, Version 1.0.", "boost"),
    ("This is free and unencumbered software released into the public domain.", "unlicense"), ("released under the WTFPL", "wtfpl"), ("Content is available under CC BY-SA 3.0", "cc-by-sa"), ("licensed under CC BY-NC-ND 4.0", "cc-by-nc-nd"),
    ("licensed under a Creative Commons Attribution-NonCommercial 4.0 license", "cc-by-nc"), ("https://creativecommons.org/licenses/by-nc-sa/4.0/", "cc-by-nc-sa"), ("https://creativecommons.org/licenses/by/4.0/", "cc-by"), ("https://creativecommons.org/publicdomain/zero/1.0/", "cc0"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "mit"), ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that", "bsd"), ("Neither the name of the Foo Project nor the names of its contributors may be used to endorse", "bsd-3-clause"),
    ("All advertising materials mentioning features or use of this software must display", "bsd-4-clause"), ("You should have received a copy of the GNU General Public License along with this program.", "gpl"),
    ("You should have received a copy of the GNU Lesser General Public License along with this library", "lgpl"), ("You should have received a copy of the GNU Affero General Public License along with", "agpl"),
    ("Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License", "gfdl"), ("You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "apache"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mpl"), ("This program and the accompanying materials are made available under the terms of the Eclipse Public License", "epl"),
    ("Altered source versions must be plainly marked as such", "zlib"), ("This Font Software is licensed under the SIL Open Font License, Version 1.1.", "ofl"), ("you can redistribute it and/or modify it under the same terms as Perl itself", "artistic"),
    ("The Software shall be used for Good, not Evil.", "json"), ("This software is based in part on the work of the Independent JPEG Group", "ijg"), ("This product includes software developed by the OpenSSL Project", "openssl"),
    ("Copyright (c) 2014-2020 Somebody. All rights reserved.", "copyright,proprietary"), ("Unauthorized copying of this file, via any medium, is strictly prohibited", "proprietary"), ("For non-commercial use only", "non-commercial"),
    ("Licensed under the GNU General Public License version 2 with Classpath exception", "gpl,classpath-exception"), ("dual licensed under the MIT and the GPL", "mit"), ("under the terms of the GPL, version 3", "gpl"), ("Licensed under the 3-clause BSD license", "bsd-3-clause"),
]
PLAIN = ["the mit campus lies by the river", "an isc of its own", "apache helicopters flew over the public road", "she used zlib to compress it", "gpl is three letters", "a boost for the artistic scene", "identify the mit student", "we see the bsd family of systems"]


@pytest.mark.parametrize(("text", "labels"), NOTICES)
def test_real_notices(text, labels):
    assert set(labels.split(",")) <= {r.label for _, _, r in license_scan.Scanner().scan(text.encode())[2]}


@pytest.mark.parametrize("text", PLAIN)
def test_plain_mentions_are_no_license(text):
    assert license_scan.Scanner().scan(text.encode())[2] == []


def test_places_take_linear_time():
    """A text of megabytes, all of it phrases."""
    import time

    s = license_scan.Scanner()
    took = []
    for n in (20_000, 160_000):
        text = b"apache license mit license " * n
        began = time.perf_counter()
        words, places, kept = s.scan(text)
        took.append(time.perf_counter() - began)
        assert words == 4 * n and len(places) == 2 * n and kept
    assert took[1] < 30 * took[0]


def test_suppression_by_priority_and_containment():
    rng = random.Random(2)
    rules = license_scan.rules()
    for _ in range(200):
        found = []
        for _ in range(rng.randint(0, 12)):
            a = rng.randint(0, 20)
            found.append((a, a + rng.randint(1, 8), rules[rng.randint(0, 5)]))
        taken = []
        for a, b, r in sorted(found, key=lambda x: (x[2].priority, x[0] - x[1], x[0])):
            if not any(s <= a and b <= e for s, e, _ in taken):
                taken.append((a, b, r))
        assert license_scan.suppress(found) == sorted(taken, key=lambda x: x[:2])


def test_license_rows(spark, odd_docs, no_docs):
    rows = license_scan.scan_licenses(odd_docs).collect()
    want = Counter((r.doc_id, *brute_places(r.text)[:1]) for r in odd_docs.collect())
    assert Counter((r.doc_id, r.n_words) for r in rows) == want
    assert all(r.base_labels == r.labels == "" and r.score == 0 and r.first_word is None for r in rows)
    assert license_scan.scan_licenses(no_docs).count() == 0


def planted(seed=3, n_docs=80):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 2, 4, 5, 8, 20, 40])))) for i in range(20)]
    docs = []
    for d in range(n_docs):
        w = [rng.choice(vocab) for _ in range(rng.randint(0, 100))]
        for _ in range(rng.randint(0, 2)):
            x = rng.choice(items)[1].split()
            for _ in range(rng.randint(0, 2)):
                k = rng.randrange(len(x)) if x else 0
                x = x[:k] + rng.choice([[], [rng.choice(vocab)], x[k : k + 1] * 2]) + x[k + 1 :]
            p = rng.randint(0, len(w))
            w[p:p] = x
        docs.append((d, (", " if d % 3 else "\n").join(w).upper() if d % 2 else " ".join(w)))
    return items, docs


def best_window(text, item):
    w, i = (decontaminate.words_of(x.encode()) for x in (text, item))
    k = min(5, len(i))
    grams = lambda x: Counter(tuple(x[q : q + k]) for q in range(len(i) - k + 1))
    return max((decontaminate.weighted_similarity(grams(i), grams(w[s : s + len(i)])) for s in range(len(w) - len(i) + 1)), default=0)


@pytest.mark.parametrize("block_bytes", [1 << 20, 200])
def test_leaks_match_brute_force(spark, block_bytes):
    items, docs = planted()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*items, (90, None), (91, "..."), (None, "w1")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.contaminated(d, b, block_bytes=block_bytes).collect()}
    want = {(i, j): s for i, t in docs for j, x in items if (s := best_window(t, x)) >= 0.8}
    assert got == want and len(want) > 30
    kept = {r.doc_id for r in decontaminate.drop_contaminated(d, b).collect()}
    assert kept == {i for i, _ in docs} - {i for i, _ in want}


def test_leaks_in_documents_shorter_than_the_item(spark):
    """A document with fewer words than the item is compared whole."""
    rng = random.Random(8)
    long, mid = ([f"v{rng.randrange(500)}" for _ in range(n)] for n in (60, 36))
    items = [(0, " ".join(long)), (1, " ".join(mid)), (2, "a b c d e f g h i"), (3, "a b c"), (4, "a a a a a a a a a a a a")]
    texts = [long[:30] + long[31:], mid[:-5], mid[:-10], long[3:], long[:40], "a b c d e f g h".split(), "a b".split(), ["a"] * 11, ["a"] * 8, []]
    for x in (long, mid):
        for _ in range(40):
            cut = list(x)
            for _ in range(rng.randint(1, 4)):
                del cut[rng.randrange(len(cut))]
            texts.append(cut[: len(cut) - rng.randint(0, 4)])
    docs = [(i, " ".join(t)) for i, t in enumerate(texts)]

    def similarity(text, item):
        k = min(5, len(item))
        a, b = (Counter(tuple(x[q : q + k]) for q in range(len(x) - k + 1)) for x in (text, item))
        return decontaminate.weighted_similarity(a, b)

    short = {(i, j): similarity(t, x.split()) for i, t in enumerate(texts) for j, x in items if len(t) < len(x.split())}
    want = {k: s for k, s in short.items() if s >= 0.8} | {(i, j): s for i, t in docs for j, x in items if (i, j) not in short and (s := best_window(t, x)) >= 0.8}
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.contaminated(d, b).collect()
    assert {(r.doc_id, r.item_id): r.similarity for r in rows} == want and {(0, 0), (1, 1), (3, 0), (5, 2), (7, 4)} <= set(want) and len(want) > 10
    assert all(r.n_words == min(len(texts[r.doc_id]), len(items[r.item_id][1].split())) for r in rows)
    assert {r.doc_id for r in decontaminate.drop_contaminated(d, b).collect()} == {i for i, _ in docs} - {i for i, _ in want}


def test_leaks_of_odd_rows(spark, odd_docs, no_docs):
    b = spark.createDataFrame([(1, "the cat sat on the mat"), (2, None)], "item_id long, text string")
    assert Counter(r.doc_id for r in decontaminate.contaminated(odd_docs, b).collect()) == {1: 1, 2: 1, 8: 2}
    assert decontaminate.contaminated(no_docs, b).count() == 0 and decontaminate.contaminated(odd_docs, b.where("false")).count() == 0


@pytest.mark.parametrize("radius", [0, 1, 2, 5, 17])
def test_multi_index_finds_all_within_the_radius(radius):
    rng = np.random.default_rng(radius)
    items = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    asked = items[rng.integers(0, 300, 400)]
    for _ in range(20):
        flip = rng.random(400) < 0.6
        asked = np.where(flip, asked ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64)), asked)
    index = decontaminate.MultiIndex(items, radius)
    want = {(i, j) for i, x in enumerate(asked) for j, y in enumerate(items) if int(x ^ y).bit_count() <= radius}
    got = list(zip(*map(list, index.near(asked)), strict=True))
    assert len(got) == len(set(got)) and set(got) == want and (want or radius < 5)


def test_rolled_fingerprints():
    rng = np.random.default_rng(4)
    own = rng.integers(0, 1 << 63, 300, dtype=np.uint64)[rng.integers(0, 200, 30000)]
    starts = np.sort(rng.choice(29900, 500, replace=False))
    want = [decontaminate.simhash(*np.unique(own[s : s + 60], return_counts=True)) for s in starts]
    assert (decontaminate.rolled(own, starts, 60) == np.array(want)).all()


def edited_passages(n=400, seed=12):
    """Items, and for each a document with the item edited so that its best window is near the threshold."""
    rng = random.Random(seed)
    items, docs = [], []
    for i in range(n):
        x = [f"v{rng.randrange(4000)}" for _ in range(rng.randint(30, 120))]
        y = list(x)
        for _ in range(rng.randint(0, max(1, len(x) // 45))):
            y[rng.randrange(len(y))] = f"n{rng.randrange(4000)}"
        around = [f"v{rng.randrange(4000)}" for _ in range(200)]
        items.append((i, " ".join(x)))
        docs.append((i, " ".join(around[:90] + y + around[90:])))
    return items, docs


def test_recall_of_edited_passages():
    """Of all passages of similarity 0.8 or more that brute force finds, at least 0.99 are found."""
    items, docs = edited_passages()
    bench = decontaminate.Benchmark([(i, t.encode()) for i, t in items])
    want = {i for (i, t), (_, d) in zip(items, docs, strict=True) if best_window(d, t) >= 0.8}
    got = {i for i, d in docs if i in {x[0] for x in bench.search(d.encode())}}
    assert got <= want and len(want) > 200 and len(got) >= 0.99 * len(want)


def test_candidates_come_from_the_index_alone(monkeypatch):
    """An index that finds nothing leaves nothing to verify, and one of radius 0 just the windows whose fingerprint equals an item's."""
    items, docs = edited_passages(60)
    found = lambda **more: {(i, x[0]) for bench in [decontaminate.Benchmark([(i, t.encode()) for i, t in items], **more)] for i, d in docs for x in bench.search(d.encode())}
    every, equal = found(), found(radius=0)
    assert equal < every
    monkeypatch.setattr(decontaminate.MultiIndex, "near", lambda self, fps: (np.zeros(0, np.int64), np.zeros(0, np.int64)))
    assert not found()


URLS = [(1, None, "", "", None, None), (2, "nothing", "", "", None, None), (3, "HTTP://A.Net/?x://q.org/fr/", "a.net", "/", "net/", "block"), (4, "http://net/en/", "net", "/en/", "net/", "block"),
        (5, "http://a.example.net/en/x#y", "a.example.net", "/en/x", "example.net/en/", "allow"), (6, "http://example.com", "example.com", "", None, None), (7, "http://xnet/", "xnet", "/", None, None),
        (8, "a\nb://Q.org/fr/\nz?", "q.org", "/fr/\nz", "org/fr/", "allow"), (9, "http://myexample.net/en/", "myexample.net", "/en/", "net/", "block"), (10, "x://example.com/de/", "example.com", "/de/", "example.com/de/", "block"), (10, "", "", "", None, None)]


def test_url_rules(spark):
    pages = spark.createDataFrame([u[:2] for u in URLS], "page_id long, url string").selectExpr("*", "'x' AS host", "1 AS ratio")
    rows = url_filter.judge(pages).collect()
    assert sorted((r.page_id, r.host, r.path, str(r.rule)) for r in rows) == sorted((u[0], u[2], u[3], str(u[4])) for u in URLS)
    assert all(r.verdict == u[5] for u in URLS for r in rows if (r.page_id, r.host) == (u[0], u[2]) and u[5])
    assert {r.verdict for r in rows} <= {"allow", "block"}
    assert url_filter.judge(pages.where("false")).count() == 0


def test_url_model_tells_apart(spark):
    rng = random.Random(4)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(8))
    rows = [(i, f"http://{word('abcd')}.net/{word('abcd')}") for i in range(300)] + [(300 + i, f"http://{word('wxyz')}.org/fr/{word('wxyz')}") for i in range(300)]
    rows += [(1000 + i, f"http://{word('abcd')}.com/{word('abcd')}") for i in range(50)] + [(2000 + i, f"http://{word('wxyz')}.com/{word('wxyz')}") for i in range(50)]
    got = {r.page_id: r.verdict for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    right = sum(got[1000 + i] == "block" for i in range(50)) + sum(got[2000 + i] == "allow" for i in range(50))
    assert right >= 95


def plain_probability(urls, context, char, order=url_filter.ORDER):
    """Witten-Bell by counting strings: the same for one class."""
    seen = Counter()
    for u in urls:
        t = b"\0" * order + u.lower() + b"\0"
        for k in range(order, len(t)):
            for n in range(order + 1):
                seen[t[k - n : k], t[k : k + 1]] += 1
    p = 1 / 256
    for n in range(order + 1):
        c = context[len(context) - n :]
        after = [v for (x, _), v in seen.items() if x == c]
        if after:
            p = (seen[c, char] + len(after) * p) / (sum(after) + len(after))
    return p


def url_model(urls, sides):
    import pyarrow as pa

    rows = [r for b in url_filter._count(iter([pa.RecordBatch.from_arrays([pa.array(urls, pa.binary()), pa.array(sides, pa.int32())], names=["url", "side"])])) for r in b.to_pylist()]
    pair, n = np.array([r["pair"] for r in rows], np.uint64), np.array([r["n"] for r in rows])
    context, at = np.unique(pair >> np.uint64(8), return_inverse=True)
    return url_filter.UrlModel(url_filter.Counts(pair, n), url_filter.Counts(context, np.bincount(at, n)), url_filter.Counts(context, np.bincount(at)))


def test_url_likelihoods_match_plain_counts_and_sum_to_one():
    rng = random.Random(6)
    urls = [f"http://{rng.choice('ab')}{rng.choice('xyz')}.org/{rng.randrange(30)}".encode() for _ in range(40)] + [b"", "http://é.net/Ü".encode()]
    sides = [k % 2 for k in range(len(urls))]
    m = url_model(urls, sides)
    for side in (0, 1):
        own = [u for u, s in zip(urls, sides, strict=True) if s == side]
        for context in (b"\0\0\0\0", b"http", b"//ax", b"org/", b"qqqq", "é.".encode().rjust(4, b"\0")):
            start = sum(c << 8 * (4 - k) for k, c in enumerate(context))
            p = m.probability(side, np.array([start + c for c in range(256)], np.uint64))
            assert abs(p.sum() - 1) < 1e-12
            for c in b"/ax.\0q":
                assert abs(p[c] - plain_probability(own, context, bytes([c]))) < 1e-12
    for u in (urls[3], b"http://ax.org/12", b""):
        t = b"\0" * 4 + u.lower() + b"\0"
        want = sum(np.log(plain_probability([x for x, s in zip(urls, sides, strict=True) if s == 0], t[k - 4 : k], t[k : k + 1]) / plain_probability([x for x, s in zip(urls, sides, strict=True) if s == 1], t[k - 4 : k], t[k : k + 1])) for k in range(4, len(t))) / (len(u) + 1)
        assert abs(m.ratio([u])[0] - want) < 1e-9


def test_counts_sent_or_joined_judge_alike(spark, monkeypatch):
    """More pairs than are sent are joined: the same ratios and verdicts, also for null ids, null and empty urls, repeated rows and names that clash."""
    rows = [(i, f"http://{'abcd'[i % 4] * 6}.{'net' if i % 2 else 'org/fr'}/{i}") for i in range(400)]
    rows += [(1000, "http://bbbbbb.com/7"), (1001, "http://aaaaaa.com/8"), (1002, None), (1003, ""), (1004, "http://É.com/ü" + "x" * 3000), (None, "http://bbbbbb.com/7"), (None, None), (5, rows[5][1]), (5, "http://cccccc.com/"), (1000, "http://bbbbbb.com/7")]
    pages = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "1 AS row", "'x' AS key", "2 AS ratio", "'y' AS pair")
    found = []
    for most in (1 << 20, 100):
        monkeypatch.setattr(url_filter, "PAIRS", most)
        found.append(sorted(((str(r.page_id), r.host, r.path, str(r.rule), r.verdict, r.ratio) for r in url_filter.judge(pages).collect())))
    sent, joined = found
    assert [r[:5] for r in sent] == [r[:5] for r in joined] and len(sent) == len(rows)
    assert max(abs(a[5] - b[5]) for a, b in zip(sent, joined, strict=True)) < 1e-9
    verdicts = {r[0]: r[4] for r in joined}
    assert verdicts["1000"] == "block" and verdicts["1001"] == "allow"
    assert len({r[4] for r in joined if r[1] == "bbbbbb.com"}) == 1
    assert url_filter.judge(pages.where("false")).count() == 0
