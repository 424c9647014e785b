import corpus_pipeline
import pytest

from postwright.llm import _common, decontaminate, exact_dedup, packing, toxicity
from test_models import corpus


def tables(spark, folder):
    docs, labels = corpus(1200)
    item = "this is the item that must never be trained on at all because it is a test"
    copies = [(2000, docs[1][1].upper()), (2001, docs[2][1]), (2002, "aa bb cc " * 40 + "dd"), (2003, "aa bb cc " * 40 + "dd ee"), (2004, f"some words {item} and others"), (2005, None), (2006, "")]
    d = spark.createDataFrame(docs + copies, "doc_id long, text string").selectExpr("*", "'en' AS lang", "'s' AS source", "cast(length(text) AS long) AS n_chars")
    d.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").selectExpr("*", "1 AS quality").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_stages_take_effect(spark, tmp_path):
    folder = tables(spark, tmp_path)
    docs = _common.table(spark, folder, "documents")
    columns = docs.columns
    seen = [{r.doc_id for r in docs.collect()}]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = _common.staged(stage(spark, docs, folder), name)
        assert docs.columns == columns
        seen.append({r.doc_id for r in docs.collect()})
    toxic, copies, near, leaks = (a - b for a, b in zip(seen, seen[1:], strict=False))
    assert sum(x % 4 == 0 for x in toxic) >= 0.95 * len(toxic) and len(toxic) > 250
    assert {1, 2, 2005} >= copies >= {2005} and 2003 in near and near & {2002, 2003} and leaks == {2004}
    rows = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in rows} == seen[-1]
    assert sum(r.length for r in rows) == sum(r.length for r in packing.token_pieces(docs).collect())


def test_stages_equal_their_operators(spark, tmp_path):
    """Each filter drops just what its operator's own rows say."""
    folder = tables(spark, tmp_path)
    docs, labels, bench = (_common.table(spark, folder, t) for t in ("documents", "labels", "benchmark"))
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    assert ids(toxicity.drop_toxic(docs, labels)) == ids(toxicity.toxicity(docs, labels).where("predicted = 0"))
    assert ids(exact_dedup.drop_exact_duplicates(docs)) == ids(exact_dedup.exact_duplicates(docs).where("kept"))
    hit = {r.doc_id for r in decontaminate.contaminated(docs, bench).collect()}
    assert ids(decontaminate.drop_contaminated(docs, bench)) == [i for i in ids(docs) if i not in hit]


@pytest.mark.parametrize("limit", [1_000_000, 1])
def test_dropping_rows_by_broadcast_or_shuffle(spark, monkeypatch, limit):
    monkeypatch.setattr(_common, "BROADCAST_IDS", limit)
    docs = spark.createDataFrame([(i, "x", "o") for i in range(10)] + [(None, "y", "o"), (None, None, "o"), (3, "z", "o")], "doc_id long, text string, own_0 string")
    dropped = docs.where("doc_id IN (3, 4) AND text = 'x' OR doc_id IS NULL AND text = 'y'").selectExpr("doc_id AS id", "xxhash64(text) AS hash")
    left = _common.without_rows(docs, "doc_id", "text", dropped.union(dropped))
    assert left.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in left.where("doc_id IS NOT NULL").collect()) == sorted([(i, "x") for i in (0, 1, 2, 5, 6, 7, 8, 9)] + [(3, "z")])
    assert [r.text for r in left.where("doc_id IS NULL").collect()] == [None]


@pytest.mark.parametrize("stage", [corpus_pipeline.drop_exact_copies, corpus_pipeline.drop_near_copies])
def test_dedup_stages_lose_no_unique_row(spark, stage):
    """Repeated ids, null ids, repeated rows and clashing names: one row of each group of equal texts stays, and every text stays."""
    same, other = "the same text in several rows of this table", "another text that nobody else has at all here"
    rows = [(5, same), (9, same), (5, other), (7, "dup dup dup dup dup dup"), (7, "dup dup dup dup dup dup"), (None, "dup dup dup dup dup dup"), (None, "alone without an id among all")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS own_0", "'x' AS __dropped", "'x' AS key", "'x' AS kept")
    kept = stage(spark, docs, "").collect()
    texts = sorted(r.text for r in kept)
    assert set(texts) == {t for _, t in rows}
    assert texts.count(same) == 1 and texts.count(other) == 1 and all(r.doc_id is not None for r in kept if r.text.startswith("dup"))


def test_pipeline_of_nothing(spark, tmp_path):
    folder = tables(spark, tmp_path)
    docs = _common.table(spark, folder, "documents").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    assert docs.count() == 0
