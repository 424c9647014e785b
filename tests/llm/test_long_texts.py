"""Texts of megabytes, and a single word of a megabyte, through every operator."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from postwright.llm import decontaminate, exact_dedup, license_scan, maxent_lm, near_copies, packing, simhash, token_files, tool_links, toxicity, url_filter
from postwright.llm.tokenize import default_path, encoder

RNG = random.Random(21)
WORDS = [f"w{RNG.randrange(5000)}" for _ in range(300_000)]
ITEM = [f"item{k}" for k in range(60)]
LONG = " ".join([*WORDS[:150_000], *ITEM, "Apache", "License", *WORDS[150_000:]])
NEAR = LONG.replace(" w17 ", " x17 ")
WORD = "a" * 1_000_000
TEXTS = [(1, LONG), (2, LONG.upper()), (3, NEAR), (4, WORD), (5, "short"), (6, None)]


@pytest.fixture(scope="module")
def docs(spark):
    assert len(LONG) > 1_500_000 and NEAR != LONG
    return spark.createDataFrame(TEXTS, "doc_id long, text string").repartition(3).persist()


def rows(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_dedup(docs):
    found = rows(exact_dedup.exact_duplicates(docs))
    assert found[1].keep_id == 2 and found[1].text_sha256 == hashlib.sha256(LONG.lower().encode()).hexdigest() and sum(r.kept for r in found.values()) == 5
    near = rows(simhash.near_duplicates(docs))
    assert near[2].component_id == near[3].component_id == 1 and near[4].component_id == 4
    assert near[1].fingerprint == f"{simhash.fingerprint(LONG.encode()):016x}"
    assert {1, 4, 5, 6} == set(rows(near_copies.drop_near_copies(docs)))


def test_scans(spark, docs):
    found = rows(license_scan.scan_licenses(docs))
    assert (found[1].n_words, found[1].n_base, found[1].first_word) == (300_062, 1, 150_060) and found[4].n_words == 1
    bench = spark.createDataFrame([(7, " ".join(ITEM))], "item_id long, text string")
    leaks = decontaminate.contaminated(docs, bench).collect()
    assert {(r.doc_id, r.start_word, r.similarity) for r in leaks} == {(k, 150_000, 1.0) for k in (1, 2, 3)}
    urls = spark.createDataFrame([(1, "http://a.net/" + "x" * 1_000_000), (2, "http://b.org/fr/" + "y" * 1_000_000), (3, "z" * 1_000_000)], "page_id long, url string")
    judged = rows(url_filter.judge(urls), "page_id")
    assert judged[1].verdict == "block" and judged[2].verdict == "allow" and judged[3].host == ""


def test_models(spark, docs):
    scores = rows(maxent_lm.scores(docs))
    assert scores[1].n_tokens == 300_063 and scores[4].n_tokens == 2 and scores[6].n_tokens == 1 and scores[1].score == pytest.approx(scores[2].score)
    labels = spark.createDataFrame([(1, 1), (4, 0), (5, 0)], "doc_id long, toxic int")
    assert len(rows(toxicity.toxicity(docs, labels))) == 6


def test_tokens(docs):
    ids = {k: np.append(encoder(default_path()).lib.encode(t or "", add_special_tokens=False).ids, 1).astype("<u4") for k, t in TEXTS}
    files = rows(token_files.token_files(docs))
    assert all((files[k].n_tokens, files[k].ids_crc32) == (len(x), zlib.crc32(x.tobytes())) for k, x in ids.items())
    pieces = packing.packed_pieces(docs).collect()
    assert {k: sum(p.length for p in pieces if p.doc_id == k) for k in ids} == {k: len(x) for k, x in ids.items()}
    assert all(p.length <= packing.CAPACITY for p in pieces)


def test_messages(spark):
    turns = [(1, 0, "user", LONG), (1, 1, "assistant", WORD), (1, 2, "user", "more")]
    found = rows(tool_links.format_conversations(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")), "turn")
    assert found[0].valid and len(found[0].message) > len(LONG) and found[1].linked_turn == 0 and found[2].order_depth == 2
