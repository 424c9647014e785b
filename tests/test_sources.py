"""Readers, writers, staged results, streams."""

import json

import numpy as np
import pytest

from postwright.operators import tokens, vocabulary
from postwright.sources import artifacts, collections, reports, staging
from postwright.streaming import counts


def test_text_formats(spark, tmp_path):
    (tmp_path / "c.tsv").write_text("0\tone\ttwo\n1\tthree\n", encoding="utf-8")
    (tmp_path / "q.tsv").write_text("7\tfirst\n3\tsecond\n")
    (tmp_path / "r.txt").write_text("7 0 1 2\n7\t0\t1\t1\n\n3 0 0 1\n")
    c = collections.read_collection(spark, f"{tmp_path}/c.tsv")
    assert sorted(map(tuple, c.collect())) == [(0, "one\ttwo"), (1, "three")] and collections.is_contiguous(c).first().contiguous
    assert [r.qid for r in collections.read_queries(spark, f"{tmp_path}/q.tsv").orderBy("ord").collect()] == [7, 3]
    assert sorted(map(tuple, collections.read_qrels(spark, f"{tmp_path}/r.txt").collect())) == [(3, 0), (7, 1)]
    collections.write_jsonl(c, f"{tmp_path}/out")
    assert sorted(r.contents for r in spark.read.json(f"{tmp_path}/out").collect()) == ["one\ttwo", "three"]


def test_domain_data(spark, tmp_path):
    (tmp_path / "qrels").mkdir()
    rows = [{"_id": "a", "title": "T", "text": "x"}, {"_id": "b", "title": "", "text": " y "}]
    (tmp_path / "corpus.jsonl").write_text("\n".join(map(json.dumps, rows)))
    (tmp_path / "queries.jsonl").write_text('{"_id": "q1", "text": "one"}\n{"_id": "q2", "text": "two"}\n{"_id": "q3", "text": "three"}')
    (tmp_path / "qrels/test.tsv").write_text("query-id\tcorpus-id\tscore\nq1\ta\t1\nq2\tb\t0\nq3\tzzz\t1\nq9\ta\t1\n")
    corpus, queries, qrels = collections.read_domain(spark, str(tmp_path))
    assert sorted(map(tuple, corpus.collect())) == [("a", "T x"), ("b", "y")]
    assert [r.query for r in queries.collect()] == ["q1"] and [tuple(r) for r in qrels.select("query", "doc").collect()] == [("q1", "a")]
    assert {r.doc: r.n for r in collections.numbered(corpus, "doc", "n").collect()} == {"a": 0, "b": 1}


def test_padded_stores_and_archives(spark, tmp_path):
    store = spark.createDataFrame([(0, [3, 1, -1], [0.5, 0.25, 0.0]), (1, [-1, -1, -1], [0.0, 0.0, 0.0])], "row_id long, idx array<int>, val array<double>")
    p = artifacts.padded_to_postings(store, "d")
    assert sorted((r.row_id, r.entry_id, r.weight, r.rank) for r in p.collect()) == [(0, 1, 0.25, 1), (0, 3, 0.5, 0)]
    assert [tuple(r) for r in artifacts.postings_to_padded(p, 3).collect()] == [(0, [3, 1, -1], [0.5, 0.25, 0.0])]
    np.savez(f"{tmp_path}/a.npz", words=np.array(["x", "y"]), freq=np.array([5, 3]))
    got = artifacts.read_npz(spark, f"{tmp_path}/a.npz").orderBy("row_id").collect()
    assert [(r.freq, json.loads(r.words)) for r in got] == [(5.0, "x"), (3.0, "y")]


def test_results_are_computed_once(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    for _ in range(2):
        assert staging.cached_result(spark, str(tmp_path), {"cap": 3, "mode": "x"}, make).count() == 3
    staging.cached_result(spark, str(tmp_path), {"cap": 4}, make)
    assert len(made) == 2
    assert staging.staged(spark.range(5), "r").count() == 5


def test_reports(spark):
    text = reports.report(spark.createDataFrame([("a", 0.123456), ("b", None)], "name string, mrr double"))
    assert "| a | 0.1235 |" in text and f"| b | {reports.MISSING} |" in text
    assert reports.with_interval(0.05, 0.01, 0.09, True) == "+0.0500 [0.0100, 0.0900]*" and reports.with_interval(None, 0, 0) == reports.MISSING


def test_streams_keep_counts(spark, tmp_path):
    p = spark.createDataFrame([(i, t) for i, t in enumerate(["a b a", "b c", None, "", "A d"])], "pid long, text string")
    p.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(p.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    want = sorted(map(tuple, vocabulary.document_counts(tokens.tokens(p)).select("word", "df", "tf").collect()))
    q = counts.running_counts(stream).writeStream.outputMode("complete").format("memory").queryName("running").option("checkpointLocation", f"{tmp_path}/c1").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("running").select("word", "df", "tf").collect())) == want
    counts.maintain(stream, f"{tmp_path}/deltas", f"{tmp_path}/c2").awaitTermination()
    assert sorted(map(tuple, counts.current(spark.read.parquet(f"{tmp_path}/deltas")).select("word", "df", "tf").collect())) == want


def test_scratch_keeps_the_last_table_alone(spark):
    with staging.scratch(spark) as made:
        a = staging.staged(spark.range(3), "a")
        b = staging.staged(a.selectExpr("id + 1 AS id"), "b")
        paths = list(made)
    assert sorted(r.id for r in b.collect()) == [1, 2, 3]
    assert [staging.exists(spark, p) for p in paths] == [False, True]


def test_a_cluster_without_a_shared_folder_is_an_error():
    class Context:
        master = "yarn"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        staging.shared_dir(Session())


def test_stages_in_any_order_and_waiting_for_each_other(spark, tmp_path):
    made = []
    stages = [("b", ("a",), lambda a: made.append("b") or a.selectExpr("id * 2 AS id")), ("a", (), lambda: made.append("a") or spark.range(3))]
    out = staging.run_stages(spark, str(tmp_path), stages)
    assert sorted(r.id for r in out["b"][0].collect()) == [0, 2, 4] and made == ["a", "b"]
    assert not any(fresh for _, fresh in staging.run_stages(spark, str(tmp_path), stages).values()) and made == ["a", "b"]
    staging.remove(spark, f"{tmp_path}/a")  # what reads a stage that is made anew is made anew too
    assert all(fresh for _, fresh in staging.run_stages(spark, str(tmp_path), stages).values())
    with pytest.raises(ValueError, match="wait"):
        staging.run_stages(spark, str(tmp_path), [("x", ("y",), None), ("y", ("x",), None)])


@pytest.mark.parametrize("rows", [4, 1000])
def test_strided_postings_and_texts(spark, tmp_path, rows):
    """Files of few rows and of all; rows that are missing, asked for twice, or beyond the end."""
    from postwright.sources import strided

    store = {r: ([r, r + 1, 7][: r % 4], [0.5, 0.25, 1 / 3][: r % 4]) for r in (0, 1, 2, 3, 5, 6, 17)}
    p = spark.createDataFrame([(r, i, v) for r, (i, v) in store.items()] + [(-1, [1], [1.0]), (None, [1], [1.0])], "row_id long, idx array<int>, val array<double>")
    folder = f"{tmp_path}/p"
    strided.write_postings(p, folder, 3, rows)
    full = lambda r: (store.get(r, ([], []))[0] + [-1] * 3)[:3]
    weights = lambda r: (store.get(r, ([], []))[1] + [0.0] * 3)[:3]
    asked = [0, 17, 5, 5, 4, 99]
    got = sorted((r.row_id, list(r.idx), list(r.val)) for r in strided.read_postings(spark.createDataFrame([(r,) for r in asked], "row_id long"), folder).collect())
    assert got == sorted((r, full(r), weights(r)) for r in asked if r < 18)
    whole = {r.row_id: (list(r.idx), list(r.val)) for r in strided.scan_postings(spark, folder).collect()}
    assert {r: v for r, v in whole.items() if v[0] != [-1] * 3} == {r: (full(r), weights(r)) for r in store if store[r][0]}
    texts = {0: "", 1: "é\tß 一", 2: None, 3: "x" * 100_000, 9: "nine", 1200: "far"}
    strided.write_texts(spark.createDataFrame(list(texts.items()), "pid long, text string"), f"{tmp_path}/t", rows)
    asked = [1200, 1, 1, 2, 0, 3, 4, 5000]
    got = sorted(tuple(r) for r in strided.read_texts(spark.createDataFrame([(i,) for i in asked], "pid long"), f"{tmp_path}/t").collect())
    assert got == sorted((i, texts[i]) for i in asked if texts.get(i) is not None)


def test_strided_stores_without_rows_and_with_repeats(spark, tmp_path):
    from postwright.sources import strided

    none = spark.createDataFrame([], "row_id long, idx array<int>, val array<double>")
    strided.write_postings(none, f"{tmp_path}/e", 2)
    assert strided.scan_postings(spark, f"{tmp_path}/e").count() == 0 and strided.read_postings(none.select("row_id"), f"{tmp_path}/e").count() == 0
    assert strided.is_whole(f"{tmp_path}/e") and not strided.is_whole(f"{tmp_path}/none")
    with pytest.raises(Exception, match="stands twice"):
        strided.write_texts(spark.createDataFrame([(1, "a"), (1, "b")], "pid long, text string"), f"{tmp_path}/r")
    assert not strided.is_whole(f"{tmp_path}/r")
