"""Encoding, postings, search, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postwright.functions import vectors
from postwright.operators import encoder, metrics, ordering, polysemy, postings, search, tokens
from postwright.plans.registry import query
from postwright.plans.world import CAP, DIM, DOCS, ENTRIES, HELD, K_D, QPOST, QRELS, QTOKENS, RUN, STORES, TAU_D, TOKENS, VOCAB, World, metrics_sql, vec_id
from postwright.sources import artifacts, staging, strided

BM25_SQL = f"""{TOKENS}, {QTOKENS}, {QRELS},
tf AS (SELECT pid, word, count(*) AS tf FROM tok GROUP BY pid, word), dl AS (SELECT pid, sum(tf) AS dl FROM tf GROUP BY pid),
tot AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl), q AS (SELECT qid, word, count(*) AS qtf FROM qtok GROUP BY qid, word),
w AS (SELECT tf.word, pid, tf, count(*) OVER (PARTITION BY tf.word) AS df FROM tf SEMI JOIN q ON tf.word = q.word),
p AS (SELECT word, pid, tf * 1.82::DOUBLE / (tf + 0.82::DOUBLE * (1 - 0.68::DOUBLE + 0.68::DOUBLE * dl / avgdl)) * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) AS weight FROM w JOIN dl USING (pid), tot),
s AS (SELECT qid, pid, round(sum(qtf * weight), 8) AS score FROM q JOIN p USING (word) GROUP BY qid, pid),
run AS (SELECT * FROM (SELECT qid, pid, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pid) AS rank FROM s) WHERE rank <= 100)"""


def bm25_run(w: World) -> DataFrame:
    return search.bm25(w.toks, w.query_toks, 100)


def ranks(run: DataFrame) -> DataFrame:
    return run.withColumn("rank", F.col("rank").cast("long"))


@query("B1 W4 O2", f"WITH {BM25_SQL} SELECT qid, pid, score, rank FROM run WHERE rank <= 10")
def bm25_top10(w: World) -> DataFrame:
    return ranks(bm25_run(w)).where("rank <= 10").select("qid", "pid", "score", "rank")


@query("B1 A11 A12 B9 J8 S13", f"WITH {BM25_SQL}, m AS ({metrics_sql()}) SELECT count(*) AS n_queries, avg(mrr) AS mrr, avg(ndcg) AS ndcg, avg(r10) AS r10, avg(r100) AS r100 FROM m", "mrr ndcg r10 r100")
def bm25_metrics(w: World) -> DataFrame:
    return metrics.mean_metrics(metrics.per_query(bm25_run(w), w.qrels))


@query("J9 B11", f"WITH {BM25_SQL} SELECT qid, pid, rank FROM run ANTI JOIN qrels USING (qid, pid)")
def hard_negatives(w: World) -> DataFrame:
    return ranks(search.hard_negatives(bm25_run(w), w.qrels)).select("qid", "pid", "rank")


@query("B11", f"WITH {QRELS} SELECT qid, min(pid) AS pid FROM qrels GROUP BY qid")
def first_positives(w: World) -> DataFrame:
    return search.first_positive(w.qrels)


@query("M1 M3 M8 M9", f"WITH {VOCAB} SELECT entry_id, {vec_id()} AS vec_id FROM vocab")
def encoded_vocabulary(w: World) -> DataFrame:
    return w.encoder.units(w.vocab).select("entry_id", "vec_id")


@query("M3 F6", f"WITH {TOKENS}, u AS (SELECT pid, {vec_id()} AS v, count(*) AS n FROM tok GROUP BY 1, 2) SELECT pid, count(*) AS states, CAST(sum(n) AS BIGINT) AS units FROM u GROUP BY pid")
def word_units(w: World) -> DataFrame:
    return w.encoder.units(w.toks).groupBy("pid", "vec_id").agg(F.count("*").alias("n")).groupBy("pid").agg(F.count("*").alias("states"), F.sum("n").alias("units"))


@query("F5 F6", "SELECT vec_id, sqrt(list_dot_product(e, e)) AS norm, list_cosine_similarity(e, f) AS cosine FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0) AS f FROM embeddings)", "norm cosine")
def vector_functions(w: World) -> DataFrame:
    first = w.states.where("vec_id = 0").select(F.col("state").alias("f"))
    return w.states.join(F.broadcast(first)).select("vec_id", vectors.norm("state").alias("norm"), vectors.cosine("state", "f").alias("cosine"))


@query("J5 A7", f"WITH {ENTRIES} SELECT entry_id, count(*) AS n, sum(sim) AS total, max(sim) AS most FROM sims GROUP BY entry_id", "total most", 9)
def similarity_profile(w: World) -> DataFrame:
    return w.moments.select("entry_id", "n", "total", "most")


@query("A6 P7", f"WITH {DOCS} SELECT pid, count(*) AS n, sum(sim) AS total FROM dprof GROUP BY pid", "total", 9)
def max_pooled(w: World) -> DataFrame:
    return postings.pooled_sums(w.keys, w.sims(TAU_D))


@query("W3 P7 P8 F10 S10", f"WITH {DOCS} SELECT pid, entry_id, weight, rank FROM docs")
def document_postings(w: World) -> DataFrame:
    return ranks(w.made_docs()).select("pid", "entry_id", "weight", "rank")


@query("W3", f"WITH {ENTRIES}, {QPOST} SELECT qid, entry_id, weight, rank FROM qpost")
def query_postings(w: World) -> DataFrame:
    return ranks(w.query_postings).select("qid", "entry_id", "weight", "rank")


@query("P8", f"WITH {DOCS} SELECT pid, sum(round(ln(1 + sim - {TAU_D}), 8)) AS total FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY round(ln(1 + sim - {TAU_D}), 8) DESC, entry_id) AS r FROM dprof) WHERE r <= {K_D} GROUP BY pid", "total", 9)
def saturated_postings(w: World) -> DataFrame:
    return w.top(TAU_D, K_D, "log1p").groupBy("pid").agg(F.sum("weight").alias("total"))


@query("S9 S10 S14 P20", f"WITH {DOCS} SELECT pid AS row_id, entry_id, weight, rank FROM docs WHERE rank < 16")
def padded_round_trip(w: World) -> DataFrame:
    """Postings through a store of fixed stride: written at known offsets, read back whole."""
    folder = w.strided("postings")
    if not strided.is_whole(folder):
        strided.write_postings(artifacts.postings_to_padded(w.docs.withColumnRenamed("pid", "row_id"), 16), folder, 16)
    return ranks(artifacts.padded_to_postings(strided.scan_postings(w.spark, folder), "d")).select("row_id", "entry_id", "weight", "rank")


@query("S9 S10", f"WITH {DOCS}, {QRELS} SELECT pid AS row_id, entry_id, weight FROM docs SEMI JOIN qrels USING (pid) WHERE rank < 16")
def strided_rows(w: World) -> DataFrame:
    """The judged passages' postings, each by one read of the store."""
    folder = w.strided("postings")
    if not strided.is_whole(folder):
        strided.write_postings(artifacts.postings_to_padded(w.docs.withColumnRenamed("pid", "row_id"), 16), folder, 16)
    asked = w.qrels.select(F.col("pid").alias("row_id")).distinct()
    return artifacts.padded_to_postings(strided.read_postings(asked, folder), "d").select("row_id", "entry_id", "weight")


@query("P19 S14", f"WITH {DOCS} SELECT entry_id, count(*) AS n FROM docs WHERE weight > 0.05 GROUP BY entry_id")
def admitted_postings(w: World) -> DataFrame:
    return postings.admitted(w.docs, 0.05).groupBy("entry_id").agg(F.count("*").alias("n"))


@query("A8 A9", f"WITH {DOCS} SELECT entry_id, coalesce(n, 0) AS df, coalesce(m, 0) AS mean_weight FROM vocab LEFT JOIN (SELECT entry_id, count(*) AS n, avg(weight) AS m FROM docs WHERE weight > 0 GROUP BY entry_id) USING (entry_id)", "mean_weight")
def entry_document_frequency(w: World) -> DataFrame:
    return postings.document_frequency(w.docs, w.vocab)


@query("A10", f"WITH {DOCS}, n AS (SELECT doc_id, count(pid) AS n FROM documents LEFT JOIN docs ON pid = doc_id GROUP BY doc_id) SELECT avg(n) AS mean_nnz, median(n) AS median_nnz, quantile_cont(n, 0.99) AS p99_nnz, avg(CASE WHEN n >= {K_D} THEN 1.0 ELSE 0 END) AS at_cap FROM n", "mean_nnz median_nnz p99_nnz at_cap")
def density(w: World) -> DataFrame:
    return postings.density(w.docs, w.passages, K_D)


@query("W15 A23", f"WITH {DOCS}, p AS (SELECT pid, max(weight) AS m, sum(weight) AS s, sum(weight * weight) AS q FROM docs GROUP BY pid) SELECT avg(m / s) AS top_share, avg(s * s / greatest(q, 1e-12)) AS participation FROM p WHERE s > 0", "top_share participation")
def weight_profile(w: World) -> DataFrame:
    return postings.weight_profile(w.docs)


@query("J3 W4 S13", f"WITH {RUN} SELECT qid, pid, score, rank FROM run")
def sparse_search(w: World) -> DataFrame:
    """The hundred best of each query, by way of the stored index."""
    return ranks(w.run).select("qid", "pid", "score", "rank")


@query("J4 J17", f"WITH {STORES}, {QRELS} SELECT q.qid, d.pid, count(*) AS shared, sum(q.weight * d.weight) AS score FROM qpost q JOIN docs d USING (entry_id) SEMI JOIN qrels r ON r.qid = q.qid AND r.pid = d.pid GROUP BY q.qid, d.pid", "score")
def relevant_contributions(w: World) -> DataFrame:
    c = search.contributions(w.query_postings, w.docs).join(w.qrels, ["qid", "pid"], "left_semi")
    return c.groupBy("qid", "pid").agg(F.count("*").alias("shared"), F.sum("part").alias("score"))


@query("A11 A12 B9", f"WITH {RUN}, {QRELS} {metrics_sql()}", "mrr ndcg r10 r100")
def per_query_metrics(w: World) -> DataFrame:
    return metrics.per_query(w.run, w.qrels)


GRID = [(k_d, k_q, t, s) for k_d in (16, 32, 64) for k_q in (8, 16, 32) for t in ((0.0, 0.0), (0.05, 0.1)) for s in ("none", "log1p")]
GRID_SQL = "grid AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {q}, {d}, {t[0]}::DOUBLE, {t[1]}::DOUBLE, '{s}')" for i, (d, q, t, s) in enumerate(GRID)) + ") t(cell, k_q, k_d, tau_q, tau_d, sat))"
GRID_RUN = f"""{STORES}, {QRELS}, {GRID_SQL},
gq AS (SELECT cell, qid, entry_id, CASE sat WHEN 'log1p' THEN ln(1 + weight - tau_q) ELSE weight - tau_q END AS w FROM qpost JOIN grid ON rank < k_q AND weight > tau_q),
gd AS (SELECT cell, pid, entry_id, CASE sat WHEN 'log1p' THEN ln(1 + weight - tau_d) ELSE weight - tau_d END AS w FROM docs JOIN grid ON rank < k_d AND weight > tau_d),
gs AS (SELECT cell, qid, pid, round(sum(gq.w * gd.w), 8) AS score FROM gq JOIN gd USING (cell, entry_id) GROUP BY cell, qid, pid),
grun AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cell, qid ORDER BY score DESC, pid) AS rank FROM gs) WHERE rank <= 10),
gm AS (SELECT cell, avg(rr) AS mrr FROM (SELECT cell, qid, coalesce(1.0 / min(CASE WHEN q.pid IS NOT NULL THEN rank END), 0) AS rr FROM grun r LEFT JOIN qrels q USING (qid, pid) WHERE qid IN (SELECT qid FROM qrels) GROUP BY cell, qid) GROUP BY cell)"""


def grid_mrr(w: World) -> DataFrame:
    grid = w.spark.createDataFrame([(i, q, d, t[0], t[1], s) for i, (d, q, t, s) in enumerate(GRID)], "cell int, k_q int, k_d int, tau_q double, tau_d double, saturation string")
    run = search.grid_search(w.query_postings, w.docs, grid, 10)
    j = metrics.judged(run, w.qrels).join(w.qrels.select("qid").distinct(), "qid", "left_semi")
    return j.groupBy("cell", "qid").agg(F.coalesce(1 / F.min(F.when(F.col("rel"), F.col("rank"))), F.lit(0.0)).alias("rr")).groupBy("cell").agg(F.avg("rr").alias("mrr"))


@query("B4 W5", f"WITH {GRID_RUN} SELECT cell, mrr FROM gm", "mrr")
def search_grid(w: World) -> DataFrame:
    return grid_mrr(w)


@query("A43", f"WITH {GRID_RUN} SELECT cell, mrr FROM gm ORDER BY round(mrr, 8) DESC, cell LIMIT 1", "mrr")
def best_grid_cell(w: World) -> DataFrame:
    return metrics.best_cell(grid_mrr(w).withColumn("mrr", F.round("mrr", 8)), "cell", "mrr")


@query("J7", f"WITH {STORES}, {QRELS}, c AS (SELECT qid, doc_id AS pid FROM (SELECT DISTINCT qid FROM qrels), (SELECT doc_id FROM documents ORDER BY md5('c|' || doc_id), doc_id LIMIT 30)) SELECT c.qid, c.pid, coalesce(score, 0) AS score FROM c LEFT JOIN (SELECT qid, pid, round(sum(q.weight * d.weight), 8) AS score FROM qpost q JOIN docs d USING (entry_id) GROUP BY qid, pid) s USING (qid, pid)")
def candidate_rescoring(w: World) -> DataFrame:
    from postwright.operators.vocabulary import uniform_sample

    c = w.qrels.select("qid").distinct().join(F.broadcast(uniform_sample(w.passages.select("pid"), "pid", 30, "c")))
    return search.rescore(c, w.query_postings, w.docs)


POOLED = f"""{TOKENS}, {QTOKENS}, emb AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS state FROM embeddings),
ex AS (SELECT vec_id, generate_subscripts(state, 1) AS i, unnest(state) AS x FROM emb),
pm AS (SELECT pid, i, sum(x * n) / sum(n) AS x FROM (SELECT pid, {vec_id()} AS v, count(*) AS n FROM tok GROUP BY 1, 2) u JOIN ex ON vec_id = v GROUP BY pid, i),
qm AS (SELECT qid, i, sum(x * n) / sum(n) AS x FROM (SELECT qid, {vec_id()} AS v, count(*) AS n FROM qtok GROUP BY 1, 2) u JOIN ex ON vec_id = v GROUP BY qid, i),
pv AS (SELECT pid, list(x ORDER BY i) AS v FROM pm GROUP BY pid), qv AS (SELECT qid, list(x ORDER BY i) AS v FROM qm GROUP BY qid),
ds AS (SELECT qid, pid, round(list_cosine_similarity(pv.v, qv.v), 8) AS score FROM pv, qv),
drun AS (SELECT * FROM (SELECT qid, pid, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pid) AS rank FROM ds) WHERE rank <= 100)"""


def dense_run(w: World) -> DataFrame:
    d, q = w.encoder.pooled(w.toks), w.encoder.pooled(w.query_toks).withColumnRenamed("pid", "qid")
    return search.dense_search(q, d, DIM, 100)


@query("M2 A4 F5", f"WITH {POOLED} SELECT pid, v[1] / sqrt(list_dot_product(v, v)) AS first, list_sum(v) / sqrt(list_dot_product(v, v)) AS total FROM pv", "first total")
def pooled_vectors(w: World) -> DataFrame:
    return w.encoder.pooled(w.toks).select("pid", F.get("vec", 0).alias("first"), F.aggregate("vec", F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("M2", f"WITH {TOKENS} SELECT pid, {vec_id('last(word ORDER BY pos)')} AS vec_id FROM tok GROUP BY pid")
def last_token_pooling(w: World) -> DataFrame:
    units = w.encoder.units(w.toks)
    return units.groupBy("pid").agg(F.max_by("vec_id", "pos").alias("vec_id"))


@query("B2 J5 W4 W11", f"WITH {POOLED} SELECT qid, pid, score, rank FROM drun WHERE rank <= 20")
def dense_search(w: World) -> DataFrame:
    return ranks(dense_run(w)).where("rank <= 20").select("qid", "pid", "score", "rank")


@query("B5 A18", f"WITH {POOLED}, {RUN.replace(TOKENS + ',', '', 1).replace('emb AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS state FROM embeddings),', '', 1).replace(QTOKENS + ',', '', 1)}, j AS (SELECT qid, pid, d.score AS a, s.score AS b FROM drun d JOIN scored s USING (qid, pid)), r AS (SELECT qid, rank() OVER (PARTITION BY qid ORDER BY a) + (count(*) OVER (PARTITION BY qid, a) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY qid ORDER BY b) + (count(*) OVER (PARTITION BY qid, b) - 1) / 2.0 AS rb FROM j) SELECT qid, count(*) AS n, corr(ra, rb) AS rho FROM r GROUP BY qid HAVING count(*) > 5", "rho")
def score_preservation(w: World) -> DataFrame:
    s = search.scores(w.query_postings, w.docs).withColumnRenamed("score", "b")
    return metrics.spearman(dense_run(w).withColumnRenamed("score", "a").join(s, ["qid", "pid"]), "a", "b", ["qid"], 5)


@query("A18", f"WITH {RUN}, r AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score, pid) AS ra, row_number() OVER (PARTITION BY qid ORDER BY pid % 97, pid) AS rb FROM run) SELECT qid, count(*) AS n, corr(ra, rb) AS rho FROM r GROUP BY qid", "rho")
def ordinal_correlation(w: World) -> DataFrame:
    return metrics.spearman_ordinal(w.run.withColumn("m", F.col("pid") % 97), "score", "m", ["qid"], "pid")


@query("J10 B5", f"WITH {BM25_SQL}, b AS (SELECT qid, pid FROM run WHERE rank <= 100), g AS (SELECT qid, pid FROM qrels) SELECT coalesce(b.qid, g.qid) AS qid, count(*) FILTER (b.pid IS NOT NULL AND g.pid IS NOT NULL) AS both, count(*) AS either, count(*) FILTER (b.pid IS NOT NULL AND g.pid IS NOT NULL) / count(*) AS jaccard FROM b FULL JOIN g ON b.qid = g.qid AND b.pid = g.pid GROUP BY 1", "jaccard")
def run_overlap(w: World) -> DataFrame:
    return search.overlap(bm25_run(w), w.qrels, "qid", "pid").withColumn("both", F.col("both").cast("long"))


@query("O4", f"WITH {BM25_SQL}, b AS (SELECT pid FROM run WHERE rank <= 10) SELECT pid FROM b UNION SELECT pid FROM qrels UNION SELECT pid FROM (SELECT doc_id AS pid FROM documents ORDER BY md5('fill|' || doc_id), doc_id LIMIT 100)")
def sub_corpus(w: World) -> DataFrame:
    from postwright.operators.vocabulary import uniform_sample

    own = search.union_of_runs([bm25_run(w)], 10)
    return own.union(w.qrels.select("pid")).union(uniform_sample(w.passages.select("pid"), "pid", 100, "fill")).distinct()


@query("J18", f"WITH {QRELS} SELECT qid, pid FROM qrels SEMI JOIN (SELECT doc_id FROM documents WHERE lang = 'en') ON doc_id = pid")
def judged_in_corpus(w: World) -> DataFrame:
    return search.in_corpus(w.qrels, w.table("documents").where("lang = 'en'").select(F.col("doc_id").alias("pid")))


@query("J6 P10", f"WITH {ENTRIES}, {HELD} SELECT h.entry_id, s.entry_id AS alias, round(list_dot_product(h.vec, s.vec), 8) AS sim FROM (SELECT * FROM ent SEMI JOIN held USING (entry_id)) h, (SELECT * FROM ent ANTI JOIN held USING (entry_id)) s QUALIFY row_number() OVER (PARTITION BY h.entry_id ORDER BY round(list_dot_product(h.vec, s.vec), 8) DESC, s.entry_id) = 1")
def nearest_seen(w: World) -> DataFrame:
    return search.nearest_seen(w.entries, w.held, DIM)


VARIANTS = f"""{RUN}, {QRELS}, {HELD},
al AS (SELECT h.entry_id, s.entry_id AS alias FROM (SELECT * FROM ent SEMI JOIN held USING (entry_id)) h, (SELECT * FROM ent ANTI JOIN held USING (entry_id)) s QUALIFY row_number() OVER (PARTITION BY h.entry_id ORDER BY round(list_dot_product(h.vec, s.vec), 8) DESC, s.entry_id) = 1),
vq AS (SELECT 'all' AS variant, qid, entry_id, weight FROM qpost UNION ALL SELECT 'seen', qid, entry_id, weight FROM qpost ANTI JOIN held USING (entry_id)
  UNION ALL SELECT 'alias', qid, coalesce(alias, entry_id), sum(weight) FROM qpost LEFT JOIN al USING (entry_id) GROUP BY 2, 3),
vs AS (SELECT variant, qid, pid, round(sum(q.weight * d.weight), 8) AS score FROM vq q JOIN docs d USING (entry_id) GROUP BY 1, 2, 3),
vrun AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY variant, qid ORDER BY score DESC, pid) AS rank FROM vs) WHERE rank <= 100)"""


def variants(w: World) -> DataFrame:
    q = w.query_postings.select("qid", "entry_id", "weight")
    forms = {"all": q, "seen": search.without(q, w.held), "alias": search.aliased(q, search.nearest_seen(w.entries, w.held, DIM))}
    out = None
    for name, f in forms.items():
        r = search.search(f.select("qid", "entry_id", "weight"), w.docs, 100).withColumn("variant", F.lit(name))
        out = r if out is None else out.unionByName(r)
    return out


@query("B10 P9 P10", f"WITH {VARIANTS} SELECT variant, qid, count(*) AS n, sum(score) AS total, max(score) AS best FROM vrun GROUP BY variant, qid", "total best", 9)
def held_out_variants(w: World) -> DataFrame:
    return variants(w).groupBy("variant", "qid").agg(F.count("*").alias("n"), F.sum("score").alias("total"), F.max("score").alias("best"))


TAU_SQL = f"""{DOCS}, c AS (SELECT round(sim, 4) AS s, count(*) AS n FROM dprof GROUP BY 1), cum AS (SELECT s, sum(n) OVER (ORDER BY s DESC) AS above FROM c)"""


@query("F12", f"WITH {TAU_SQL} SELECT max(s) - 0.00005 AS tau FROM cum WHERE above >= 20 * (SELECT count(*) FROM documents)", "tau")
def fitted_tau(w: World) -> DataFrame:
    counts = postings.leading_counts(staging.staged(w.keys, "keys"), w.states, w.entries, DIM, TAU_D, round(w.n_docs * 20))
    tau = postings.tau_of_counts(counts, w.n_docs, 20)
    return w.spark.createDataFrame([(tau,)], "tau double")


@query("A42", f"WITH {ENTRIES} SELECT avg(CASE WHEN sim < 0.2 THEN 1.0 ELSE 0 END) * 100 AS below FROM sims", "below")
def similarity_below_tau(w: World) -> DataFrame:
    from postwright.operators.diagnostics import below_tau

    return below_tau(w.moments)


@query("G19 A41", f"WITH {DOCS}, {HELD}, allp AS (SELECT * FROM dprof), b AS (SELECT pid, count(*) AS b FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY round(sim - {TAU_D}, 8) DESC, entry_id) AS r FROM dprof ANTI JOIN held USING (entry_id)) WHERE r <= {CAP} GROUP BY pid), m AS (SELECT pid, count(*) AS n, count(*) FILTER (entry_id NOT IN (SELECT entry_id FROM held)) AS kept FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY round(sim - {TAU_D}, 8) DESC, entry_id) AS r FROM dprof) WHERE r <= {CAP} GROUP BY pid), j AS (SELECT greatest(b - coalesce(kept, 0), 0) AS lost, coalesce(n, 0) AS n FROM b LEFT JOIN m USING (pid)) SELECT avg(lost) AS mean_lost, avg(CASE WHEN lost > 0 THEN 1.0 ELSE 0 END) AS share_losing, avg(CASE WHEN n >= {CAP} THEN 1.0 ELSE 0 END) AS share_at_cap FROM j", "mean_lost share_losing share_at_cap")
def store_evictions(w: World) -> DataFrame:
    """Held-out entries stand for inserted ones in a capped store."""
    base, merged = w.top(TAU_D, CAP, entries=w.seen), w.top(TAU_D, CAP)
    return postings.evictions(merged, base, w.held, CAP)


@query("J16 G18 G7", f"WITH {STORES}, {HELD}, t AS (SELECT * FROM (SELECT pid, entry_id, round(sim - {TAU_D}, 8) AS weight, row_number() OVER (PARTITION BY pid ORDER BY round(sim - {TAU_D}, 8) DESC, entry_id) AS r FROM dprof ANTI JOIN held USING (entry_id)) WHERE r <= {K_D}), i AS (SELECT * FROM (SELECT pid, entry_id, round(sim - {TAU_D}, 8) AS weight, row_number() OVER (PARTITION BY pid ORDER BY round(sim - {TAU_D}, 8) DESC, entry_id) AS r FROM dprof SEMI JOIN held USING (entry_id)) WHERE r <= {K_D}), u AS (SELECT * FROM t UNION ALL SELECT * FROM i), s AS (SELECT qid, pid, round(sum(q.weight * u.weight), 8) AS score FROM qpost q JOIN u USING (entry_id) GROUP BY qid, pid) SELECT qid, pid, score FROM s QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, pid) <= 20")
def two_stores(w: World) -> DataFrame:
    trained, inserted = w.top(TAU_D, K_D, entries=w.seen), w.top(TAU_D, K_D, entries=w.held)
    return search.search(w.query_postings, postings.merge_stores(trained, inserted), 20).select("qid", "pid", "score")


@query("A4 M11 G5", f"WITH {VOCAB}, emb AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS state FROM embeddings), nx AS (SELECT word, lead(word) OVER (PARTITION BY pid ORDER BY pos) AS nxt FROM tok), p AS (SELECT entry_id, {vec_id('nxt')} AS v, count(*) AS n FROM nx JOIN vocab USING (word) WHERE nxt IS NOT NULL GROUP BY 1, 2), ex AS (SELECT vec_id, generate_subscripts(state, 1) - 1 AS i, unnest(state) AS x FROM emb) SELECT entry_id, i, sum(n * x) / sum(n) AS x FROM p JOIN ex ON vec_id = v GROUP BY entry_id, i", "x")
def context_prototypes(w: World) -> DataFrame:
    """An entry's prototype: the mean state of the words that follow it."""
    nxt = tokens.successions(w.passages).join(F.broadcast(w.vocab.select("word", "entry_id")), "word").select("entry_id", F.col("next").alias("word"))
    counted = w.encoder.units(nxt).groupBy("entry_id", "vec_id").agg(F.count("*").alias("n"))
    m = w.encoder.means(counted, "entry_id")
    return m.select("entry_id", F.posexplode("vec").alias("i", "x")).withColumn("i", F.col("i").cast("long"))


@query("A5", "SELECT vec_id, (v * 3 + u * 1) / 4 AS x, v AS y FROM (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS v, CAST(embedding[64] AS DOUBLE) AS u FROM embeddings)", "x y")
def merged_halves(w: World) -> DataFrame:
    a, b = F.array(F.get("state", 0)), F.array(F.get("state", 63))
    return w.states.select("vec_id", F.get(vectors.weighted_merge(a, F.lit(3), b, F.lit(1)), 0).alias("x"), F.get(vectors.weighted_merge(a, F.lit(0), b, F.lit(0)), 0).alias("y"))


@query("E7 W3", f"WITH {DOCS} SELECT pid, entry_id, weight FROM docs SEMI JOIN (SELECT doc_id AS pid FROM documents ORDER BY md5('exp|' || doc_id), doc_id LIMIT 60) USING (pid) WHERE rank < 20")
def expansion_sample(w: World) -> DataFrame:
    from postwright.operators.vocabulary import uniform_sample

    return polysemy.expansions(w.docs, uniform_sample(w.passages.select("pid"), "pid", 60, "exp"), 20).select("pid", "entry_id", "weight")


@query("P11", f"WITH {TOKENS}, ph AS (SELECT phrase FROM (VALUES ('worthless'), ('gnu general'), ('license, version'), ('the and')) t(phrase)) SELECT doc_id AS pid, phrase FROM documents, ph WHERE contains(lower(text), phrase)")
def phrase_matches(w: World) -> DataFrame:
    ph = w.spark.createDataFrame([("worthless",), ("gnu general",), ("license, version",), ("the and",)], "phrase string")
    return tokens.contains_phrase(w.passages, ph)


def boot_sql(source: str, columns: str, seed: str, resamples: int = 200) -> str:
    """(b, means) over resamples of a table expression (qid, columns)."""
    means = ", ".join(f"sum(w * {c}) / sum(w) AS {c}" for c in columns.split())
    weight = " + ".join(f"(u >= {c})::INT" for c in metrics.POISSON)
    return f"""v AS ({source}), draws AS (SELECT *, {weight} AS w FROM (SELECT *, CAST(('0x' || substr(md5('{seed}|' || b || '|' || qid), 1, 8)) AS BIGINT) % 1000000 AS u FROM v, range({resamples}) t(b))),
means AS (SELECT b, {means} FROM draws WHERE w > 0 GROUP BY b)"""


def draw_sql(source: str, columns: str, seed: str, resamples: int = 200) -> str:
    """``boot_sql`` with as many draws as there are rows, with replacement."""
    means = ", ".join(f"avg({c}) AS {c}" for c in columns.split())
    return f"""v AS ({source}), rows_ AS (SELECT *, row_number() OVER (ORDER BY qid) - 1 AS i, count(*) OVER () AS n FROM v),
draws AS (SELECT b, CAST(('0x' || substr(md5('{seed}|' || b || '|' || i), 1, 8)) AS BIGINT) % n AS j FROM rows_, range({resamples}) t(b)),
means AS (SELECT b, {means} FROM draws JOIN rows_ ON rows_.i = j GROUP BY b)"""


@query("A34 B9", f"WITH {BM25_SQL}, m AS ({metrics_sql()}), {draw_sql('SELECT qid, ndcg FROM m', 'ndcg', 'boot')} SELECT (SELECT avg(ndcg) FROM v) AS mean, quantile_cont(ndcg, 0.025) AS lo, quantile_cont(ndcg, 0.975) AS hi FROM means", "mean lo hi")
def bootstrap_interval(w: World) -> DataFrame:
    return metrics.bootstrap_interval(metrics.per_query(bm25_run(w), w.qrels), "ndcg", 200)


PAIR = f"{RUN}, {QRELS}, a AS ({metrics_sql()}), hrun AS (SELECT * FROM (SELECT qid, pid, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pid) AS rank FROM (SELECT qid, pid, round(sum(q.weight * d.weight), 8) AS score FROM (SELECT * FROM qpost WHERE rank < 4) q JOIN docs d USING (entry_id) GROUP BY qid, pid)) WHERE rank <= 100), bb AS ({metrics_sql('hrun')})"


def pair(w: World) -> tuple[DataFrame, DataFrame]:
    short = w.query_postings.where("rank < 4")
    return metrics.per_query(w.run, w.qrels), metrics.per_query(search.search(short, w.docs, 100), w.qrels)


@query("A35 G20 B6", f"WITH {PAIR}, {boot_sql('SELECT a.qid, a.r100 - bb.r100 AS d FROM a JOIN bb USING (qid)', 'd', 'pair')} SELECT (SELECT avg(d) FROM v) AS diff, quantile_cont(d, 0.025) AS lo, quantile_cont(d, 0.975) AS hi, least(1.0, 2 * least(avg(CASE WHEN d <= 0 THEN 1.0 ELSE 0 END), avg(CASE WHEN d >= 0 THEN 1.0 ELSE 0 END))) AS p, quantile_cont(d, 0.025) > 0 OR quantile_cont(d, 0.975) < 0 AS excludes_zero FROM means", "diff lo hi p")
def paired_bootstrap(w: World) -> DataFrame:
    a, b = pair(w)
    return metrics.paired_bootstrap(a, b, "r100", 200)


@query("A20", "WITH r AS (SELECT toxic, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0 AS r FROM documents JOIN labels USING (doc_id)) SELECT CAST(sum(toxic) AS BIGINT) AS n_pos, CAST(sum(1 - toxic) AS BIGINT) AS n_neg, (sum(CASE WHEN toxic = 1 THEN r END) - sum(toxic) * (sum(toxic) + 1) / 2.0) / (sum(toxic)::DOUBLE * sum(1 - toxic)) AS auc FROM r", "auc")
def label_auc(w: World) -> DataFrame:
    return metrics.auc(w.table("documents").join(w.table("labels"), "doc_id"), "n_chars", "toxic")


@query("A19", "WITH x AS (SELECT quality AS g, CAST(n_chars AS DOUBLE) AS v, toxic AS side FROM documents JOIN labels USING (doc_id)), n AS (SELECT g, v, count(*) FILTER (side = 0) AS a, count(*) FILTER (side = 1) AS b FROM x GROUP BY g, v), c AS (SELECT g, sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER (PARTITION BY g) AS na, sum(b) OVER (PARTITION BY g) AS nb, lead(v) OVER (PARTITION BY g ORDER BY v) - v AS gap FROM n WINDOW w AS (PARTITION BY g ORDER BY v)) SELECT g, sum(coalesce(abs(ca / na - cb / nb) * gap, 0)) AS w1 FROM c WHERE na > 0 AND nb > 0 GROUP BY g", "w1")
def label_wasserstein(w: World) -> DataFrame:
    x = w.table("documents").join(w.table("labels"), "doc_id").select(F.col("quality").alias("g"), F.col("n_chars").cast("double").alias("v"), F.col("toxic").alias("side"))
    return metrics.wasserstein(x, "v", "side", ["g"])


@query("W3 W11", "SELECT source, doc_id, rank FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents) WHERE rank <= 5")
def longest_by_source(w: World) -> DataFrame:
    return ranks(ordering.top_k(w.table("documents"), ["source"], [F.desc("n_chars"), F.col("doc_id")], 5)).select("source", "doc_id", "rank")
