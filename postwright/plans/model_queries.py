"""Encoders of several layers, expansion, late interaction, training, archives and stages."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postwright.operators import decisions, encoder, geometry, metrics, postings, probes, search, sparse_training, tokens, vocabulary
from postwright.plans.registry import query
from postwright.plans.retrieval_queries import BM25_SQL, VARIANTS, bm25_run, boot_sql, variants
from postwright.plans.world import DIM, ENTRIES, QRELS, QTOKENS, RUN, TOKENS, VOCAB, World, metrics_sql, vec_id
from postwright.sources import artifacts, staging
from postwright.sources.log import Log, seeded

# --- layers ---

TOP_LAYER = 3


def layered_sql(words: str, name: str) -> str:
    """(key, layer, state) of a table expression (key, word)."""
    return f"""{name}m AS (SELECT key, mark, CASE WHEN mark > 0 THEN word || '~' || mark ELSE word END AS w FROM ({words}), range({TOP_LAYER + 1}) t(mark)),
{name}x AS (SELECT key, mark, generate_subscripts(state, 1) AS i, unnest(state) AS x FROM {name}m JOIN emb ON vec_id = {vec_id("w")}),
{name}s AS (SELECT key, layer, i, avg(x) AS x FROM {name}x, range({TOP_LAYER + 1}) t(layer) WHERE mark <= layer GROUP BY key, layer, i),
{name}v AS (SELECT key, layer, list(x ORDER BY i) AS v FROM {name}s GROUP BY key, layer),
{name} AS (SELECT key, layer, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS state FROM {name}v)"""


LAYERS = f"""{ENTRIES}, {layered_sql("SELECT entry_id AS key, word FROM vocab", "le")}, {layered_sql("SELECT entry_id AS key, word || '#1' AS word FROM vocab", "lp")},
ls AS (SELECT lp.key AS probe, lp.layer, le.key AS entry_id, round(list_dot_product(lp.state, le.state), 8) AS sim FROM lp JOIN le USING (layer)),
lm AS (SELECT probe, layer, sim AS own FROM ls WHERE probe = entry_id),
lr AS (SELECT probe, layer, count(*) FILTER (sim > own) AS r FROM ls JOIN lm USING (probe, layer) GROUP BY probe, layer),
lay AS (SELECT CAST(layer AS INTEGER) AS layer, round(avg(CASE WHEN r < 10 THEN 1.0 ELSE 0 END), 8) AS hit10, round(avg(1.0 / (r + 1)), 8) AS rel_mrr FROM lr GROUP BY layer)"""


def layer_rows(w: World) -> DataFrame:
    enc = encoder.LayeredEncoder(w.encoder, TOP_LAYER)
    entries = enc.states(w.vocab.select("entry_id", "word"), "entry_id").persist()
    marked = enc.states(w.vocab.select("entry_id", F.concat("word", F.lit("#1")).alias("word")), "entry_id").persist()
    out = None
    for layer in range(TOP_LAYER + 1):
        e = entries.where(F.col("layer") == layer).select("entry_id", F.col("state").alias("vec"))
        p = marked.where(F.col("layer") == layer).select(F.col("entry_id").alias("probe"), F.col("entry_id").alias("own_id"), "state")
        m = probes.probe_metrics(p, e, DIM, 0.2).agg(F.round(F.avg((F.col("self_rank") < 10).cast("double")), 8).alias("hit10"), F.round(F.avg(1 / (F.col("self_rank") + 1)), 8).alias("rel_mrr"))
        m = m.select(F.lit(layer).alias("layer"), "hit10", "rel_mrr")
        out = m if out is None else out.union(m)
    return out


@query("M3 B7 B12", f"WITH {LAYERS} SELECT layer, hit10, rel_mrr FROM lay", "hit10 rel_mrr")
def layer_probe(w: World) -> DataFrame:
    """How well marked words find their own entry, layer by layer."""
    return layer_rows(w)


@query("D1 B7", f"WITH {LAYERS} SELECT layer, hit10, rel_mrr FROM lay ORDER BY hit10 DESC, rel_mrr DESC, layer LIMIT 1", "hit10 rel_mrr")
def best_probed_layer(w: World) -> DataFrame:
    return decisions.best_layer(layer_rows(w))


@query("D1 A43", f"WITH {LAYERS} SELECT metric, arg_max(layer, (v, -layer)) AS layer FROM (UNPIVOT (SELECT * FROM lay) ON hit10, rel_mrr INTO NAME metric VALUE v) GROUP BY metric")
def best_layer_by_metric(w: World) -> DataFrame:
    return decisions.best_by_metric(layer_rows(w), ["hit10", "rel_mrr"])


@query("M4", f"WITH {VOCAB}, emb AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS state FROM embeddings), {layered_sql('SELECT entry_id AS key, word FROM vocab', 'le')} SELECT key AS entry_id, CAST(layer AS INTEGER) AS layer, list_sum(state) AS total FROM le WHERE layer <= 1", "total")
def truncated_layers(w: World) -> DataFrame:
    """An encoder cut off after its second layer gives the lower layers as they are."""
    s = encoder.LayeredEncoder(w.encoder, TOP_LAYER).truncated(1).states(w.vocab.select("entry_id", "word"), "entry_id")
    return s.select("entry_id", "layer", F.aggregate("state", F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("F8 F9", """WITH x AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
z AS (SELECT vec_id, e, greatest(list_sum(e), 0) AS a, greatest(list_sum(list_transform(e, lambda v, i: CASE WHEN i % 2 = 1 THEN v ELSE -v END)), 0) AS b FROM x),
h AS (SELECT vec_id, list_transform(e, lambda v, i: v + 0.25 * a - CASE WHEN i % 4 = 1 THEN 0.5 ELSE 0 END * b) AS h FROM z)
SELECT vec_id, list_sum(h) / sqrt(list_dot_product(h, h)) AS total, h[1] / sqrt(list_dot_product(h, h)) AS first FROM h""", "total first")
def residual_head(w: World) -> DataFrame:
    """A head of two hidden units, both matrices at work."""
    w1 = np.stack([np.ones(DIM), np.where(np.arange(DIM) % 2 == 0, 1.0, -1.0)])
    w2 = np.stack([np.full(DIM, 0.25), np.where(np.arange(DIM) % 4 == 0, -0.5, 0.0)], axis=1)
    h = geometry.head(w.states.select("vec_id", "state"), w1, w2, "state", "relu")
    return h.select("vec_id", F.aggregate("state", F.lit(0.0), lambda a, x: a + x).alias("total"), F.get("state", 0).alias("first"))


# --- expansion and late interaction ---


@query("M5", f"""WITH {ENTRIES}, p AS (SELECT qid, entry_id, max(sim) AS sim FROM (SELECT DISTINCT item_id AS qid, {vec_id('lower(word)')} AS v FROM (SELECT item_id, unnest(regexp_extract_all(text, '[A-Za-z0-9]+')) AS word FROM benchmark)) JOIN sims ON vec_id = v WHERE sim > 0 GROUP BY 1, 2)
SELECT qid, entry_id, weight, rank FROM (SELECT qid, entry_id, round(ln(1 + sim), 8) AS weight, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(ln(1 + sim), 8) DESC, entry_id) - 1 AS INTEGER) AS rank FROM p) WHERE rank < 48""", "weight")
def expanded_queries(w: World) -> DataFrame:
    """Texts as weights over the whole vocabulary: the largest log(1 + max(logit, 0)) of any token (an expansion encoder over the lookup table)."""
    return postings.pooled_postings(w.query_keys, w.sims(0.0, of=w.query_keys, most=48, saturation="log1p"), 0.0, 48, row="qid", saturation="log1p")


@query("M6", f"""WITH {RUN}, c AS (SELECT qid, pid FROM run WHERE rank <= 10), qu AS (SELECT DISTINCT qid, {vec_id()} AS v FROM qtok), du AS (SELECT DISTINCT pid, {vec_id()} AS v FROM tok WHERE pid IN (SELECT pid FROM c)),
ss AS (SELECT a.vec_id AS a, b.vec_id AS b, list_dot_product(a.state, b.state) AS sim FROM emb a, emb b),
best AS (SELECT c.qid, c.pid, qu.v, max(sim) AS sim FROM c JOIN qu USING (qid) JOIN du USING (pid) JOIN ss ON ss.a = qu.v AND ss.b = du.v GROUP BY 1, 2, 3)
SELECT qid, pid, sum(sim) AS score FROM best GROUP BY qid, pid""", "score")
def late_interaction(w: World) -> DataFrame:
    """The ten best of the sparse run, scored token by token."""
    c = w.run.where("rank <= 10").select("qid", "pid")
    return search.late_interaction(c, w.encoder.units(w.query_toks).withColumnRenamed("pid", "qid"), w.encoder.units(w.toks), w.states, DIM)


@query("G27", f"""WITH {TOKENS}, emb AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS state FROM embeddings), x AS (SELECT word, lead(word) OVER (PARTITION BY pid ORDER BY pos) AS nxt FROM tok),
ph AS (SELECT word, nxt, count(*) AS n FROM x WHERE nxt IS NOT NULL GROUP BY word, nxt ORDER BY n DESC, word, nxt LIMIT 200),
v AS (SELECT ph.word, nxt, n, a.state AS s, b.state AS t FROM ph JOIN emb a ON a.vec_id = {vec_id('ph.word')} JOIN emb b ON b.vec_id = {vec_id('nxt')})
SELECT word || ' ' || nxt AS phrase, n, (s[1] + t[1]) / 2 AS first, (list_sum(s) + list_sum(t)) / 2 AS total FROM v""", "first total")
def phrase_prototypes(w: World) -> DataFrame:
    """The two hundred most frequent bigrams as entries: the mean state of their words."""
    pairs = w.successors.orderBy(F.desc("n"), "word", "next").limit(200)
    parts = pairs.select(F.concat_ws(" ", "word", "next").alias("phrase"), F.col("n").alias("times"), F.explode(F.array("word", "next")).alias("word"))
    units = w.encoder.with_states(w.encoder.units(parts))
    mean = encoder.mean_vector(units, ["phrase", "times"], "state", name="vec")
    return mean.select("phrase", F.col("times").alias("n"), F.get("vec", 0).alias("first"), F.aggregate("vec", F.lit(0.0), lambda a, x: a + x).alias("total"))


# --- training ---


def examples(w: World, own: int = 8, most: int = 32) -> DataFrame:
    """A passage's first words ask for what follows them; the passage after the next by hash is a negative."""
    toks = tokens.truncated_words(w.passages, own + most).where(F.size("words") > own)
    keys = lambda c: F.array_distinct(F.transform(c, w.encoder.vec_id))
    e = toks.select(F.col("pid").alias("example"), keys(F.slice("words", 1, own)).alias("query"), keys(F.slice("words", own + 1, most)).alias("right"), F.pmod(F.xxhash64("pid"), F.lit(1 << 20)).alias("near"))
    e = staging.staged(e, "examples")
    other = e.groupBy("near").agg(F.min_by("right", "example").alias("wrong")).select((F.col("near") + 1).alias("near"), "wrong")
    return e.join(other, "near", "left").select("example", "query", F.when(F.col("wrong").isNull(), F.array("right")).otherwise(F.array("right", "wrong")).alias("docs"))


@query("X4 S17 X1 X2", None, "rate ramp ce accuracy nnz_q nnz_d flops_q flops_d")
def training_curve(w: World) -> DataFrame:
    """Six steps of the sparse head over all passages, broken off after three and gone on with from the checkpoint; tested against a plain loop."""
    s = sparse_training.Settings(dim=DIM, batches=max(1, w.n_docs // 64), steps=6, warmup=2, rate=0.01, drop=0.3, every=3)
    folder = sparse_training.run_folder(w.spark, uuid.uuid4().hex)
    plain = w.entries.select("entry_id", F.lit(1.0).alias("a"), F.lit(0.0).alias("b"))
    for until in (3, None):
        end = sparse_training.train(examples(w), w.states, w.entries, plain, s, folder, until)
    return end.history


@query("A33", f"""WITH {VARIANTS}, per AS (SELECT variant, qid, r.ndcg FROM (SELECT 'all' AS variant, * FROM ({metrics_sql("(SELECT * FROM vrun WHERE variant = 'all')")}) UNION ALL SELECT 'seen', * FROM ({metrics_sql("(SELECT * FROM vrun WHERE variant = 'seen')")}) UNION ALL SELECT 'alias', * FROM ({metrics_sql("(SELECT * FROM vrun WHERE variant = 'alias')")})) r),
{boot_sql("SELECT qid, a.ndcg - s.ndcg AS num, o.ndcg - s.ndcg AS den FROM (SELECT * FROM per WHERE variant = 'alias') a JOIN (SELECT * FROM per WHERE variant = 'seen') s USING (qid) JOIN (SELECT * FROM per WHERE variant = 'all') o USING (qid)", "num den", "rho")},
rh AS (SELECT CASE WHEN abs(den) > 1e-12 THEN num / den END AS rho, den FROM means)
SELECT (SELECT count(*) FROM v) AS n, (SELECT CASE WHEN abs(avg(den)) > 1e-12 THEN avg(num) / avg(den) END FROM v) AS rho, quantile_cont(rho, 0.025) AS lo, quantile_cont(rho, 0.975) AS hi,
  (SELECT avg(den) FROM v) >= 0.02 AND (quantile_cont(den, 0.025) > 0 OR quantile_cont(den, 0.975) < 0) AS valid FROM rh""", "rho lo hi")
def recovery_ratio(w: World) -> DataFrame:
    """Aliases stand for the model and the whole vocabulary for the oracle."""
    v = variants(w).persist()
    m = {name: metrics.per_query(v.where(F.col("variant") == name).drop("variant"), w.qrels) for name in ("all", "seen", "alias")}
    return metrics.recovery_ratio(m["alias"], m["seen"], m["all"], m["seen"], "ndcg", 200)


# --- archives, results, stages, logs ---

SPLITS = f"""{QRELS}, r AS (SELECT doc_id AS pid, row_number() OVER (ORDER BY md5('splits|' || doc_id), doc_id) AS r FROM documents),
sp AS (SELECT pid, 'Q' AS name FROM r WHERE r <= 40 UNION ALL SELECT pid, 'S' FROM r WHERE r > 40 AND r <= 140 UNION ALL SELECT pid, 'P' FROM r WHERE r > 40 AND pid NOT IN (SELECT pid FROM qrels))"""


def own_folder(w: World, name: str) -> str:
    return f"{staging.shared_dir(w.spark)}/postwright/{name}-{uuid.uuid4().hex}"


@query("S8 P5", f"WITH {SPLITS} SELECT pid, name FROM sp WHERE name <> 'P'")
def archived_splits(w: World) -> DataFrame:
    """The two samples written as a numpy archive in the shared folder and read back."""
    rows = vocabulary.splits(w.passages.select("pid"), w.qrels.select("pid").distinct(), 40, 100).where("name <> 'P'").toArrow()
    path = f"{own_folder(w, 'splits')}/splits.npz"
    artifacts.save_npz(path, pid=rows.column("pid").to_numpy(), is_query=np.array([n == "Q" for n in rows.column("name").to_pylist()]))
    back = artifacts.read_npz(w.spark, path)
    return back.select(F.col("pid").cast("long").alias("pid"), F.when(F.col("is_query") > 0, "Q").otherwise("S").alias("name"))


@query("S15 S18", f"WITH {BM25_SQL}, m AS ({metrics_sql()}) SELECT avg(mrr) AS mrr, avg(ndcg) AS ndcg, 'metrics_bm25_docs' AS name FROM m", "mrr ndcg")
def stored_metrics(w: World) -> DataFrame:
    """A result as JSON under its tagged name, loaded again."""
    r = metrics.per_query(bm25_run(w), w.qrels).agg(F.avg("mrr").alias("mrr"), F.avg("ndcg").alias("ndcg")).first()
    name = artifacts.tagged("metrics", "docs", system="bm25")
    path = f"{own_folder(w, 'results')}/{name}.json"
    artifacts.save_json(path, {"mrr": np.float64(r.mrr), "ndcg": r.ndcg, "name": name})
    back = artifacts.load_json(path)
    return w.spark.createDataFrame([(back["mrr"], back["ndcg"], back["name"])], "mrr double, ndcg double, name string")


@query("E3", f"WITH {VOCAB} SELECT 'vocab' AS stage, count(*) AS n, true AS made, false AS made_again FROM vocab UNION ALL SELECT 'frequent', count(*), true, true FROM vocab WHERE freq >= 500")
def resumed_stages(w: World) -> DataFrame:
    """Two stages, run, one of them removed, run again: only what is missing is made."""
    folder = own_folder(w, "stages")
    stages = [("frequent", ("vocab",), lambda v: v.where("freq >= 500")), ("vocab", (), lambda: w.vocab)]
    first = staging.run_stages(w.spark, folder, stages)
    staging.remove(w.spark, f"{folder}/frequent")
    again = staging.run_stages(w.spark, folder, stages)
    rows = [(name, again[name][0].count(), first[name][1], again[name][1]) for name in ("vocab", "frequent")]
    return w.spark.createDataFrame(rows, "stage string, n long, made boolean, made_again boolean")


@query("S21", "SELECT * FROM (VALUES ('count', (SELECT count(*) FROM documents), NULL::VARCHAR), ('fails', NULL, 'ValueError(''on purpose'')'), ('seed', 3::BIGINT, NULL)) t(event, n, failed)")
def logged_steps(w: World) -> DataFrame:
    """Timed steps, one that fails, and a seed, read back from the log."""
    path = f"{own_folder(w, 'log')}/run.jsonl"
    log = Log(path)
    with log.timed("count", n=w.n_docs):
        w.n_docs
    try:
        with log.timed("fails"):
            raise ValueError("on purpose")
    except ValueError:
        pass
    log.event("seed", n=int((seeded(5).random(3) == seeded(5).random(3)).sum()))
    log.close()
    return w.spark.read.schema("event string, n long, failed string, at double, seconds double").json(path).select("event", "n", "failed")
