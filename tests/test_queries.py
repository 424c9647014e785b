"""Registered queries against their SQL, on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from postwright.plans import QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "events documents embeddings pages benchmark labels conversations".split()
SHOWN = """qrels_sets title_case_bigrams vocabulary_table corpus_splits occurrence_sample extended_vocabulary units_from_pieces interval_overlap sense_labels prefix_offsets
bm25_metrics hard_negatives document_postings sparse_search search_grid dense_search store_evictions bootstrap_interval label_auc label_wasserstein hubness lift_and_harm
probe_metrics grouped_summary gate_dfdrop calibrate_z mean_and_covariance held_clusters five_way_verdict layer_probe index_bounds index_work impact_search background_statistics related_rank sense_accuracy stability_curve kmeans_clusters refreshed_entries refreshed_normalisation pilot_verdict calibration_study residual_head late_interaction archived_splits resumed_stages logged_steps""".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(v):
    return f"{v:.5f}" if isinstance(v, float) and not math.isnan(v) else str(v)


@pytest.mark.parametrize("name", SHOWN)
def test_same_rows_as_sql(spark, duck, name):
    got, want = QUERIES[name](spark, DATA), duck.sql(QUERIES[name].oracle())
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    a = sorted(tuple(plain(r[c]) for c in columns) for r in got.collect())
    b = sorted(tuple(plain(v) for v in r) for r in want.project(", ".join(columns)).fetchall())
    assert a == b
    spark.catalog.clearCache()


def test_every_query_says_what_it_shows():
    assert len(QUERIES) > 120 and all(q.rows for q in QUERIES.values())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert all(name in entry.oracle_sql() for name, q in QUERIES.items() if q.sql)


def test_entry_gives_the_flagship(spark):
    assert entry.entry(spark).columns == ["qid", "pid", "score", "rank"]
