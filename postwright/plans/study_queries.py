"""Diagnostics, probes, insertion, gates, calibration, geometry, losses, decisions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postwright.functions.hashing import sample_key
from postwright.functions.vectors import dot
from postwright.operators import clusters, diagnostics, geometry, impact_index, insertion, metrics, postings, probes, refresh, search, tokens, training, vocabulary
from postwright.operators.ordering import top_k
from postwright.plans.registry import query
from postwright.plans.world import CTOKENS, DIM, DOCS, ENTRIES, HELD, QRELS, RUN, SENSES, STORES, TAU_D, TAU_Q, VOCAB, World, metrics_sql, vec_id
from postwright.sources import staging

# --- background statistics and hubness ---

STATS = f"""{ENTRIES}, {HELD},
m AS (SELECT entry_id, avg(sim) AS mean, greatest(stddev_pop(sim), 1e-12) AS sd FROM sims GROUP BY entry_id),
tl AS (SELECT entry_id, sim AS tail FROM sims QUALIFY row_number() OVER (PARTITION BY entry_id ORDER BY sim DESC) = greatest(CAST(floor(0.02 * (SELECT count(*) FROM embeddings)) AS BIGINT), 8)),
st AS (SELECT entry_id, decile, held.entry_id IS NOT NULL AS held, mean, sd, tail FROM vocab LEFT JOIN held USING (entry_id) JOIN m USING (entry_id) JOIN tl USING (entry_id))"""


def entry_stats(w: World, entries: DataFrame | None = None) -> DataFrame:
    """Background statistics of the vocabulary's entries, or of another version of them."""
    marks = w.held.withColumn("h", F.lit(True))
    m = diagnostics.tail_place(0.98, w.encoder.n)
    moments = w.moments if entries is None else postings.similarity_moments(w.states, entries, DIM, TAU_Q)
    b, t = diagnostics.background(moments), postings.nth_largest(w.states, w.entries if entries is None else entries, DIM, m)
    stats = w.vocab.select("entry_id", "decile").join(marks, "entry_id", "left").join(b, "entry_id").join(t, "entry_id").select("entry_id", "decile", F.coalesce("h", F.lit(False)).alias("held"), "mean", "sd", "tail")
    return staging.staged(stats, "entry-stats")  # a row an entry, read many times: the products behind it are made once


@query("A27 A28", f"WITH {STATS} SELECT entry_id, mean, sd, tail FROM st", "mean sd")
def background_statistics(w: World) -> DataFrame:
    return entry_stats(w).select("entry_id", "mean", "sd", "tail")


HUBS = f"""{ENTRIES}, top AS (SELECT entry_id FROM sims QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, entry_id) <= 10),
hub AS (SELECT entry_id, coalesce(n, 0) AS n FROM vocab LEFT JOIN (SELECT entry_id, count(*) AS n FROM top GROUP BY entry_id) USING (entry_id))"""


@query("A17", f"WITH {HUBS} SELECT entry_id, n FROM hub")
def hub_counts(w: World) -> DataFrame:
    return diagnostics.hub_counts(postings.nearest_entries(w.states, w.entries, DIM, 10), w.vocab)


@query("A17 B13", f"""WITH {HUBS}, t AS (SELECT avg(n) AS mu, count(*) AS c, sum(n) AS total, max(n) AS most FROM hub),
  o AS (SELECT n, row_number() OVER (ORDER BY n, entry_id) AS i FROM hub)
  SELECT (SELECT avg(power(n - mu, 3)) / power(avg(power(n - mu, 2)), 1.5) FROM hub, t) AS skewness,
  sum(CASE WHEN i > c - greatest(1, floor(c / 100)) THEN n ELSE 0 END) / any_value(total) AS top1_share, any_value(most) AS most,
  sum((2 * i - c - 1) * n) / (any_value(c) * any_value(total)) AS gini FROM o, t""", "skewness top1_share gini")
def hubness(w: World) -> DataFrame:
    return diagnostics.hubness(diagnostics.hub_counts(postings.nearest_entries(w.states, w.entries, DIM, 10), w.vocab))


@query("A14", f"WITH {STATS}, d AS (SELECT decile, median(mean) FILTER (NOT held) AS m, quantile_disc(tail, 0.5) FILTER (NOT held) AS t FROM st GROUP BY decile) SELECT decile, coalesce(m, (SELECT median(mean) FROM st WHERE NOT held)) AS mean_target, coalesce(t, (SELECT quantile_disc(tail, 0.5) FROM st WHERE NOT held)) AS tail_target FROM d", "mean_target tail_target")
def decile_targets(w: World) -> DataFrame:
    s = entry_stats(w)
    return diagnostics.decile_target(s, "mean").withColumnRenamed("target", "mean_target").join(diagnostics.decile_target(s, "tail", lower=True).withColumnRenamed("target", "tail_target"), "decile")


DF = f"""{STORES}, {HELD}, dfq AS (SELECT entry_id, decile, held.entry_id IS NOT NULL AS held, CAST(coalesce(n, 0) AS DOUBLE) AS df, coalesce(m, 0) AS mw FROM vocab LEFT JOIN held USING (entry_id) LEFT JOIN (SELECT entry_id, count(*) AS n, avg(weight) AS m FROM docs GROUP BY entry_id) USING (entry_id))"""


def df_stats(w: World) -> DataFrame:
    marks = w.held.withColumn("h", F.lit(True))
    d = postings.document_frequency(w.docs, w.vocab)
    return w.vocab.select("entry_id", "decile").join(marks, "entry_id", "left").join(d, "entry_id").select("entry_id", "decile", F.coalesce("h", F.lit(False)).alias("held"), F.col("df").cast("double").alias("df"), F.col("mean_weight").alias("mw"))


@query("A29", f"""WITH {DF}, d AS (SELECT decile, median(df) FILTER (held) AS mh, median(df) FILTER (NOT held) AS ms, count(*) FILTER (held) AS nh, count(*) FILTER (NOT held) AS ns FROM dfq GROUP BY decile),
  g AS (SELECT ln((mh + 1e-9) / (ms + 1e-9)) AS g FROM d WHERE nh >= 1 AND ns >= 20)
  SELECT median(g) AS gap, max(abs(g)) AS largest, (SELECT avg(CASE WHEN df = 0 THEN 1.0 ELSE 0 END) FROM dfq WHERE held) AS dead_held, (SELECT avg(CASE WHEN df = 0 THEN 1.0 ELSE 0 END) FROM dfq WHERE NOT held) AS dead_seen FROM g""", "gap largest dead_held dead_seen")
def activation_gap(w: World) -> DataFrame:
    return diagnostics.activation_gap(df_stats(w), "df")


@query("A30", f"""WITH {STATS}, l AS (UNPIVOT (SELECT decile, held, mean, sd, tail FROM st) ON mean, sd, tail INTO NAME statistic VALUE v),
  d AS (SELECT decile, statistic, median(v) FILTER (held) AS h, median(v) FILTER (NOT held) AS s, count(*) FILTER (held) AS nh, count(*) FILTER (NOT held) AS ns FROM l GROUP BY decile, statistic)
  SELECT statistic, median(h - s) AS gap FROM d WHERE nh >= 1 AND ns >= 20 GROUP BY statistic""", "gap")
def statistic_gaps(w: World) -> DataFrame:
    return diagnostics.median_gaps(entry_stats(w), ["mean", "sd", "tail"])


@query("A38 G10", f"WITH {DF}, r AS (SELECT df / (SELECT count(*) FROM documents) AS rate FROM dfq) SELECT avg(rate) AS mean_rate, median(rate) AS median_rate, count(*) FILTER (rate = 0) AS never, count(*) FILTER (rate > 0.2) AS over_fifth, count(*) FILTER (rate > 0.5) AS over_half FROM r", "mean_rate median_rate")
def firing_summary(w: World) -> DataFrame:
    return diagnostics.firing_summary(insertion.firing_rates(w.docs, w.vocab.select("entry_id"), w.n_docs))


# --- score mass and held-out queries: the held-out entries stand for inserted ones ---

MASS = f"""{STORES}, {QRELS}, {HELD}, c AS (SELECT q.qid, d.pid, entry_id, q.weight * d.weight AS part FROM qpost q JOIN docs d USING (entry_id)),
mass AS (SELECT entry_id, coalesce(sum(part) FILTER (r.pid IS NOT NULL), 0) AS relevant, coalesce(sum(part) FILTER (c.pid IS NOT NULL AND r.pid IS NULL), 0) AS irrelevant FROM held LEFT JOIN c USING (entry_id) LEFT JOIN qrels r ON r.qid = c.qid AND r.pid = c.pid GROUP BY entry_id)"""


@query("A36 J17", f"WITH {MASS} SELECT * FROM mass", "relevant irrelevant")
def score_mass(w: World) -> DataFrame:
    return diagnostics.score_mass(w.query_postings, w.docs, w.qrels, w.held)


@query("A39", f"""WITH {MASS}, b AS (SELECT (SELECT count(*) FROM qrels) / ((SELECT count(*) FROM benchmark) * (SELECT count(*) FROM documents)::DOUBLE) AS rate),
  l AS (SELECT entry_id, relevant, irrelevant, CASE WHEN relevant + irrelevant > 0 THEN relevant / (relevant + irrelevant) / rate END AS lift FROM mass, b)
  SELECT *, coalesce(lift < 1, false) AS harmful, -ln(greatest(lift, 1e-6)) AS harm FROM l""", "relevant irrelevant lift harm")
def lift_and_harm(w: World) -> DataFrame:
    rate = w.qrels.count() / (w.n_queries * w.n_docs)
    return diagnostics.lift(diagnostics.score_mass(w.query_postings, w.docs, w.qrels, w.held), rate).withColumn("harm", F.when(F.col("lift").isNotNull(), F.col("harm")).otherwise(F.lit(13.815510557964274)))


@query("A37", f"""WITH {MASS}, s AS (SELECT qid, pid, round(sum(part), 8) AS score, sum(CASE WHEN entry_id IN (SELECT entry_id FROM held) THEN part ELSE 0 END) AS own FROM c GROUP BY qid, pid),
  t AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, pid) <= 10)
  SELECT r.pid IS NOT NULL AS rel, avg(own / score) AS share FROM t LEFT JOIN qrels r ON r.qid = t.qid AND r.pid = t.pid GROUP BY 1""", "share")
def inserted_score_share(w: World) -> DataFrame:
    return diagnostics.inserted_share(w.query_postings, w.docs, w.qrels, w.held)


@query("A31", f"""WITH {MASS}, s AS (SELECT qid, sum(part) AS t, sum(CASE WHEN entry_id IN (SELECT entry_id FROM held) THEN part ELSE 0 END) AS own FROM c SEMI JOIN qrels USING (qid, pid) GROUP BY qid)
  SELECT qid, CASE WHEN coalesce(t, 0) > 0 THEN own / t ELSE 0 END AS share FROM (SELECT DISTINCT qid FROM qrels) LEFT JOIN s USING (qid) WHERE CASE WHEN coalesce(t, 0) > 0 THEN own / t ELSE 0 END >= 0.1""", "share")
def held_out_queries(w: World) -> DataFrame:
    return diagnostics.held_queries(w.query_postings, w.docs, w.qrels, w.held, 0.1)


@query("A32", f"WITH {VOCAB}, qtok AS (SELECT item_id AS qid, lower(unnest(regexp_extract_all(text, '[A-Za-z0-9]+'))) AS word FROM benchmark), {QRELS}, {HELD}, hw AS (SELECT word FROM vocab SEMI JOIN held USING (entry_id)) SELECT DISTINCT q.qid FROM (SELECT DISTINCT qid, word FROM qtok SEMI JOIN hw USING (word)) q JOIN qrels USING (qid) JOIN (SELECT DISTINCT pid, word FROM tok) t USING (pid, word)")
def lexical_held_out_queries(w: World) -> DataFrame:
    words = w.vocab.join(w.held, "entry_id", "left_semi")
    q = w.query_toks.select(F.col("pid").alias("qid"), "word").distinct()
    return diagnostics.lexical_held_queries(q, w.toks.select("pid", "word").distinct(), w.qrels, words)


# --- probes: occurrences of words as probes of their own entries ---

PROBES = f"""{ENTRIES}, pr AS (SELECT DISTINCT entry_id AS probe, entry_id AS own_id, v FROM (SELECT entry_id, {vec_id("word || '#1'")} AS v FROM vocab)),
ps AS (SELECT probe, own_id, sims.entry_id, sim FROM pr JOIN sims ON vec_id = v), mine AS (SELECT probe, sim AS own_sim FROM ps WHERE entry_id = own_id)"""


def marked_words(w: World) -> DataFrame:
    """Each word's probe is the state of the word with a mark, so that it is not its own entry's vector."""
    p = w.encoder.with_states(w.encoder.units(w.vocab.select("entry_id", F.concat("word", F.lit("#1")).alias("word"))))
    return p.select(F.col("entry_id").alias("probe"), F.col("entry_id").alias("own_id"), "state")


def probe_rows(w: World) -> DataFrame:
    return probes.probe_metrics(marked_words(w), w.entries, DIM, 0.2)


@query("W2 A22 A23 B12", f"""WITH {PROBES} SELECT probe, count(*) FILTER (sim > own_sim) AS self_rank, (max(sim) - quantile_disc(sim, 0.5)) / greatest(stddev_samp(sim), 1e-6) AS z_gap,
  power(sum(greatest(sim - 0.2, 0)), 2) / greatest(sum(power(greatest(sim - 0.2, 0), 2)), 1e-12) AS participation FROM ps JOIN mine USING (probe) GROUP BY probe""", "z_gap participation")
def probe_metrics(w: World) -> DataFrame:
    return probe_rows(w).drop("own_sim")


@query("A21", f"""WITH {PROBES} SELECT probe, avg(CASE WHEN sim < own_sim THEN 1.0 ELSE 0 END) AS auc FROM (SELECT * FROM ps WHERE entry_id <> own_id QUALIFY row_number() OVER (PARTITION BY probe ORDER BY md5('auc|' || probe || '|' || entry_id), entry_id) <= 4) JOIN mine USING (probe) GROUP BY probe""", "auc")
def matched_random_auc(w: World) -> DataFrame:
    p = marked_words(w)
    own = p.select("probe", F.col("own_id").alias("entry_id"))
    drawn = staging.staged(probes.random_targets(p.select("probe", "own_id"), w.vocab), "drawn")
    sims = staging.staged(probes.target_similarities(p, drawn.union(own), w.entries, DIM), "target-sims")
    mine = sims.join(own, ["probe", "entry_id"]).select("probe", F.col("sim").alias("own_sim"))
    return probes.matched_random_auc(sims.join(drawn, ["probe", "entry_id"]), mine)


@query("W7", f"""WITH {PROBES}, rk AS (SELECT probe, entry_id, rank() OVER (PARTITION BY probe ORDER BY sim DESC) AS r FROM ps) SELECT probe, avg(1.0 / r) AS mrr FROM rk WHERE entry_id % 20 = probe % 20 GROUP BY probe""", "mrr")
def related_rank(w: World) -> DataFrame:
    e = w.vocab.select("entry_id", (F.col("entry_id") % 20).alias("kin"))
    related = e.select(F.col("entry_id").alias("probe"), "kin").join(e, "kin").select("probe", "entry_id")  # within a bounded vocabulary
    return probes.related_rank(probes.target_ranks(marked_words(w), related, w.entries, DIM))


@query("W8 B13", f"WITH {PROBES}, r AS (SELECT probe, count(*) FILTER (sim > own_sim) + 1 AS rank FROM ps JOIN mine USING (probe) GROUP BY probe) SELECT median(rank) AS median_rank, avg(CASE WHEN rank = 1 THEN 1.0 ELSE 0 END) AS first, avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0 END) AS top10 FROM r", "median_rank first top10")
def self_activation(w: World) -> DataFrame:
    return probes.self_activation(probe_rows(w))


@query("A24", f"""WITH {PROBES}, r AS (SELECT probe AS entry_id, CAST(count(*) FILTER (sim > own_sim) AS DOUBLE) AS v FROM ps JOIN mine USING (probe) GROUP BY probe), x AS (SELECT is_stop, decile, v FROM r JOIN vocab USING (entry_id))
  SELECT 'all' AS part, count(*) AS n, avg(v) AS mean FROM x UNION ALL SELECT CASE WHEN is_stop THEN 'stop' ELSE 'content' END, count(*), avg(v) FROM x GROUP BY is_stop UNION ALL SELECT 'decile ' || decile, count(*), avg(v) FROM x WHERE NOT is_stop GROUP BY decile""", "mean")
def grouped_summary(w: World) -> DataFrame:
    m = probe_rows(w).join(w.vocab.withColumnRenamed("entry_id", "probe"), "probe")
    return probes.grouped_summary(m.withColumn("v", F.col("self_rank").cast("double")), "v")


@query("A25", f"""WITH {ENTRIES}, {SENSES}, dw AS (SELECT DISTINCT pid, word FROM tok),
  lab AS (SELECT pid, w AS word, min(sense) AS sense FROM (SELECT DISTINCT dw.pid, ind.word AS w, sense FROM dw JOIN ind ON dw.word = ind.term) GROUP BY pid, w HAVING min(sense) = max(sense)),
  oc AS (SELECT pid, word, arg_min(nxt, pos) AS nxt FROM (SELECT pid, pos, word, lead(word) OVER (PARTITION BY pid ORDER BY pos) AS nxt FROM tok) WHERE nxt IS NOT NULL GROUP BY pid, word),
  x AS (SELECT pid, word, sense, state FROM lab JOIN oc USING (pid, word) JOIN emb ON vec_id = {vec_id('nxt')}),
  m AS (SELECT pid, word, avg(sim) FILTER (anchor_sense = sense) - avg(sim) FILTER (anchor_sense <> sense) AS margin
        FROM (SELECT x.pid, x.word, sense, anchor_sense, round(list_dot_product(state, vec), 8) AS sim FROM x JOIN anc ON anc.word = x.word JOIN ent USING (entry_id)) GROUP BY pid, word)
  SELECT word, count(*) AS n, avg(CASE WHEN margin > 0 THEN 1.0 ELSE 0 END) AS accuracy FROM m GROUP BY ROLLUP (word)""", "accuracy")
def sense_accuracy(w: World) -> DataFrame:
    """Passages tell a word's sense by its mined terms; its state there is that of the word after its first place."""
    labelled = tokens.co_occurrence_label(w.passages, w.senses)
    places = tokens.successions(w.passages).join(F.broadcast(w.senses.select("word").distinct()), "word", "left_semi").groupBy("pid", "word").agg(F.min_by("next", "pos").alias("next"))
    x = labelled.join(places, ["pid", "word"]).select(F.concat_ws("|", "pid", "word").alias("probe"), F.col("word").alias("own"), "sense", F.col("next").alias("word"))
    x = w.encoder.with_states(w.encoder.units(x)).select("probe", F.col("own").alias("word"), "sense", "state")
    asked = w.anchors.select("word", "entry_id").distinct().join(w.entries, "entry_id")  # a few entries of each word
    sims = x.join(F.broadcast(asked), "word").select("probe", "word", "sense", "entry_id", F.round(dot("state", "vec"), postings.DIGITS).alias("sim"))
    return probes.sense_accuracy(sims, w.anchors)


def followed(w: World, passages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entry_id, pid) of the passages where an entry's word has a next one, each once, and (entry_id, pid, pos, next) of all such places."""
    known = F.broadcast(w.vocab.select("word", "entry_id"))
    return tokens.followed_words(passages).join(known, "word").select("entry_id", "pid"), tokens.successions(passages).join(known, "word").select("entry_id", "pid", "pos", "next")


def occurrences(w: World, near: DataFrame) -> DataFrame:
    """(entry_id, pid, slot, vec_id): an entry's sampled occurrences, drawn from those of ``near``; the state of one is that of the word after the entry's first place in the passage that has one."""
    slots = vocabulary.occurrence_sample(near, most=2 * diagnostics.HALF)
    nxt = near.groupBy("entry_id", "pid").agg(F.min_by("next", "pos").alias("word"))
    return w.encoder.units(nxt.join(slots, ["entry_id", "pid"])).select("entry_id", "pid", "slot", "vec_id")


def occurrence_prototypes(w: World) -> DataFrame:
    return diagnostics.nested_prototypes(w.encoder.with_states(occurrences(w, vocabulary.bounded_sample(*followed(w, w.passages), most=2 * diagnostics.HALF)[1])))


def curve(w: World) -> DataFrame:
    return diagnostics.stability_curve(occurrence_prototypes(w), w.states.select(F.col("vec_id").alias("pid"), F.col("state").alias("vec")), DIM)


CURVE = f"""{VOCAB}, emb AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS state FROM embeddings),
nx AS (SELECT pid, pos, word, lead(word) OVER (PARTITION BY pid ORDER BY pos) AS nxt FROM tok),
oc AS (SELECT entry_id, pid, arg_min(nxt, pos) AS nxt FROM nx JOIN vocab USING (word) WHERE nxt IS NOT NULL GROUP BY entry_id, pid),
sl AS (SELECT entry_id, nxt, row_number() OVER (PARTITION BY entry_id ORDER BY md5('occ|' || entry_id || '|' || pid), pid) - 1 AS slot FROM oc QUALIFY slot < {2 * diagnostics.HALF}),
oe AS (SELECT entry_id, slot // {diagnostics.HALF} AS half, slot % {diagnostics.HALF} AS place, generate_subscripts(state, 1) AS i, unnest(state) AS x FROM sl JOIN emb ON vec_id = {vec_id('nxt')}),
ks AS (SELECT unnest({list(diagnostics.CURVE)}) AS k),
pm AS (SELECT entry_id, half, k, i, sum(x) AS x FROM oe JOIN ks ON place < k GROUP BY entry_id, half, k, i),
pv AS (SELECT entry_id, half, k, list(x ORDER BY i) AS v FROM pm GROUP BY entry_id, half, k),
pn AS (SELECT entry_id, half, k, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM pv QUALIFY count(*) OVER (PARTITION BY entry_id, k) = 2),
nb AS (SELECT entry_id, half, k, vec_id FROM pn, emb QUALIFY row_number() OVER (PARTITION BY entry_id, half, k ORDER BY round(list_dot_product(v, state), 8) DESC, vec_id) <= {diagnostics.NEIGHBOURS}),
ov AS (SELECT entry_id, k, count(*) FILTER (n = 2) / count(*) AS jaccard FROM (SELECT entry_id, k, vec_id, count(*) AS n FROM nb GROUP BY entry_id, k, vec_id) GROUP BY entry_id, k),
cs AS (SELECT a.entry_id, a.k, list_dot_product(a.v, b.v) AS cosine FROM pn a JOIN pn b ON a.entry_id = b.entry_id AND a.k = b.k AND a.half = 0 AND b.half = 1),
cur AS (SELECT k, count(*) AS n, avg(jaccard) AS jaccard, avg(cosine) AS cosine FROM ov JOIN cs USING (entry_id, k) GROUP BY k)"""


@query("A26 B13", f"WITH {CURVE} SELECT * FROM cur", "jaccard cosine")
def stability_curve(w: World) -> DataFrame:
    """Prototypes of 1 to 50 occurrences from two disjoint halves of an entry's sample."""
    return curve(w)


@query("W12", f"WITH {CURVE} SELECT min(k) AS k FROM cur WHERE jaccard >= 0.8 * (SELECT jaccard FROM cur WHERE k = 50)")
def first_stable_depth(w: World) -> DataFrame:
    return probes.first_reaching(curve(w), "k", "jaccard")


# --- insertion filters, gates, calibration ---

RATES = f"{STORES}, {HELD}, qr AS (SELECT entry_id, coalesce(n, 0) / (SELECT count(*)::DOUBLE FROM benchmark) AS rate FROM vocab LEFT JOIN (SELECT entry_id, count(*) AS n FROM qpost GROUP BY entry_id) USING (entry_id)), dr AS (SELECT entry_id, coalesce(n, 0) / (SELECT count(*)::DOUBLE FROM documents) AS rate FROM vocab LEFT JOIN (SELECT entry_id, count(*) AS n FROM docs GROUP BY entry_id) USING (entry_id))"


def rates(w: World, held: bool, on_queries: bool) -> DataFrame:
    entries = w.held if held else w.vocab.select("entry_id").join(w.held, "entry_id", "left_anti")
    return insertion.firing_rates(w.query_postings if on_queries else w.docs, entries, w.n_queries if on_queries else w.n_docs)


@query("G9", f"WITH {RATES} SELECT entry_id, rate FROM qr SEMI JOIN held USING (entry_id) WHERE rate <= 0.05", "rate")
def query_firing_filter(w: World) -> DataFrame:
    return insertion.keep_quiet(rates(w, True, True), 0.05)


@query("G10 A8", f"WITH {RATES} SELECT entry_id, rate FROM dr SEMI JOIN held USING (entry_id) WHERE rate <= 0.10", "rate")
def document_firing_filter(w: World) -> DataFrame:
    return insertion.keep_quiet(rates(w, True, False), 0.10)


@query("G11", f"WITH {RATES}, l AS (SELECT quantile_cont(rate, 0.9) AS lim FROM dr ANTI JOIN held USING (entry_id) WHERE rate > 0) SELECT entry_id, rate FROM dr SEMI JOIN held USING (entry_id), l WHERE rate <= lim", "rate")
def relative_filter(w: World) -> DataFrame:
    return insertion.keep_relative(rates(w, True, False), rates(w, False, False), 90.0)


@query("G12", f"WITH {RATES}, h AS (SELECT * FROM dr SEMI JOIN held USING (entry_id)) SELECT entry_id, rate FROM h WHERE (SELECT avg(rate) FROM h) < 0.01 OR rate <= 0.10", "rate")
def gated_filter(w: World) -> DataFrame:
    return insertion.keep_gated(rates(w, True, False), 0.10)


GATE = f"{STORES}, {HELD}, mk AS (SELECT q.*, h.entry_id IS NOT NULL AS ins, count(h.entry_id) OVER (PARTITION BY qid) AS n_ins FROM qpost q LEFT JOIN held h USING (entry_id) WHERE weight > 0)"


@query("G13", f"WITH {GATE} SELECT qid, any_value(n_ins) AS n_ins FROM mk GROUP BY qid")
def inserted_counts(w: World) -> DataFrame:
    return insertion.inserted_count(w.query_postings, w.held)


@query("G14", f"WITH {GATE} SELECT qid, entry_id, weight FROM mk WHERE NOT (ins AND n_ins > 5)")
def gate_all(w: World) -> DataFrame:
    return insertion.gate(w.query_postings, w.held, 5, "all")


@query("G15", f"WITH {GATE} SELECT qid, entry_id, weight FROM (SELECT *, row_number() OVER (PARTITION BY qid, ins ORDER BY weight DESC, entry_id) AS r FROM mk) WHERE NOT (ins AND n_ins > 5) OR r <= 5")
def gate_topk(w: World) -> DataFrame:
    return insertion.gate(w.query_postings, w.held, 5, "topk")


@query("G16", f"WITH {GATE}, dr AS (SELECT entry_id, count(*) / (SELECT count(*)::DOUBLE FROM documents) AS rate FROM docs GROUP BY entry_id) SELECT qid, entry_id, weight FROM mk LEFT JOIN dr USING (entry_id) WHERE NOT (ins AND n_ins > 5) OR coalesce(rate, 0) <= 0.15")
def gate_dfdrop(w: World) -> DataFrame:
    return insertion.gate(w.query_postings, w.held, 5, "dfdrop", rates(w, True, False), 0.15)


@query("G17 G7 G20", f"""WITH {RUN}, {HELD}, g AS (SELECT qid FROM qpost SEMI JOIN held USING (entry_id) GROUP BY qid HAVING count(*) > 5),
  b AS (SELECT qid, pid, round(sum(q.weight * d.weight), 8) AS score FROM (SELECT * FROM qpost ANTI JOIN held USING (entry_id)) q JOIN docs d USING (entry_id) GROUP BY qid, pid),
  br AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pid) AS rank FROM b)
  SELECT qid, pid, score FROM run ANTI JOIN g USING (qid) WHERE rank <= 20 UNION ALL SELECT qid, pid, score FROM br SEMI JOIN g USING (qid) WHERE rank <= 20""")
def gate_fallback(w: World) -> DataFrame:
    base = search.search(search.without(w.query_postings, w.held), w.docs, 20)
    return insertion.fallback(search.search(w.query_postings, w.docs, 20), base, insertion.inserted_count(w.query_postings, w.held), 5).select("qid", "pid", "score")


@query("G20 G7", f"""WITH {RUN}, {QRELS}, {HELD}, bs AS (SELECT qid, pid, round(sum(q.weight * d.weight), 8) AS score FROM (SELECT * FROM qpost ANTI JOIN held USING (entry_id)) q JOIN docs d USING (entry_id) GROUP BY qid, pid),
  brun AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pid) AS rank FROM bs) WHERE rank <= 100), a AS ({metrics_sql()}), b AS ({metrics_sql('brun')})
  SELECT 'with' AS system, count(*) AS n_queries, avg(mrr) AS mrr, avg(ndcg) AS ndcg, avg(r10) AS r10, avg(r100) AS r100 FROM a UNION ALL SELECT 'without', count(*), avg(mrr), avg(ndcg), avg(r10), avg(r100) FROM b""", "mrr ndcg r10 r100")
def with_and_without(w: World) -> DataFrame:
    both = insertion.with_and_without(w.query_postings, search.without(w.query_postings, w.held), w.docs, w.docs, 100).persist()
    out = None
    for s in ("with", "without"):
        m = metrics.mean_metrics(metrics.per_query(both.where(F.col("system") == s).drop("system"), w.qrels)).withColumn("system", F.lit(s))
        out = m if out is None else out.unionByName(m)
    return out


Z = f"{STATS}, tg AS (SELECT decile, coalesce(median(mean) FILTER (NOT held), (SELECT median(mean) FROM st WHERE NOT held)) AS m, coalesce(median(sd) FILTER (NOT held), (SELECT median(sd) FROM st WHERE NOT held)) AS s, coalesce(quantile_disc(tail, 0.5) FILTER (NOT held), (SELECT quantile_disc(tail, 0.5) FROM st WHERE NOT held)) AS t FROM st GROUP BY decile)"


@query("G21 G25 F11", f"WITH {Z} SELECT entry_id, s / sd AS a, m - mean * s / sd AS b FROM st JOIN tg USING (decile) WHERE held", "a b")
def calibrate_z(w: World) -> DataFrame:
    return insertion.affine_z(entry_stats(w))


@query("G24", f"WITH {Z} SELECT entry_id, 1.0::DOUBLE AS a, 0.5 * (t - tail) AS b FROM st JOIN tg USING (decile) WHERE held", "a b")
def calibrate_tail(w: World) -> DataFrame:
    return insertion.affine_tail(entry_stats(w), 0.5)


@query("G22", f"WITH {PROBES}, {HELD}, sa AS (SELECT probe AS entry_id, decile, held.entry_id IS NOT NULL AS held, own_sim AS sa FROM mine JOIN vocab ON vocab.entry_id = probe LEFT JOIN held ON held.entry_id = probe), t AS (SELECT decile, coalesce(median(sa) FILTER (NOT held), (SELECT median(sa) FROM sa WHERE NOT held)) AS t FROM sa GROUP BY decile) SELECT entry_id, CASE WHEN abs(sa) > 1e-6 THEN t / sa ELSE 1 END AS a, 0.0::DOUBLE AS b FROM sa JOIN t USING (decile) WHERE held", "a b")
def calibrate_self(w: World) -> DataFrame:
    sa = probe_rows(w).select(F.col("probe").alias("entry_id"), F.col("own_sim").alias("sa"))
    s = w.vocab.select("entry_id", "decile").join(w.held.withColumn("h", F.lit(True)), "entry_id", "left").join(sa, "entry_id").select("entry_id", "decile", F.coalesce("h", F.lit(False)).alias("held"), "sa")
    return insertion.affine_self(s)


@query("G21 F10", f"WITH {Z}, af AS (SELECT entry_id, s / sd AS a, m - mean * s / sd AS b FROM st JOIN tg USING (decile) WHERE held) SELECT entry_id, sum(coalesce(a * sim + b, sim)) AS total FROM sims LEFT JOIN af USING (entry_id) GROUP BY entry_id", "total")
def calibrated_similarities(w: World) -> DataFrame:
    sums = w.moments.join(insertion.affine_z(entry_stats(w)), "entry_id", "left")
    return sums.select("entry_id", F.coalesce(F.col("a") * F.col("total") + F.col("b") * F.col("n"), F.col("total")).alias("total"))


def shift_sql(steps: int = 12) -> str:
    """(entry_id, shift) as ``sh``: the steps written out."""
    parts = [f"""up AS (SELECT pid, entry_id, max(sim) AS sim FROM (SELECT DISTINCT pid, {vec_id()} AS v FROM tok) u JOIN sims s ON s.vec_id = u.v GROUP BY pid, entry_id),
tg AS (SELECT decile, coalesce(median(df) FILTER (NOT held), (SELECT median(df) FROM dfq WHERE NOT held)) AS target FROM dfq GROUP BY decile),
fc AS (SELECT entry_id, target, round(sim, 4) AS s, count(*) AS n FROM up JOIN dfq USING (entry_id) JOIN tg USING (decile) WHERE held GROUP BY 1, 2, 3), h0 AS (SELECT DISTINCT entry_id, 0.0::DOUBLE AS shift FROM fc)"""]
    for i in range(steps):
        parts.append(f"""h{i + 1} AS (SELECT entry_id, CASE WHEN c < target THEN shift + 0.5::DOUBLE / {i + 1} WHEN c > target THEN shift - 0.5::DOUBLE / {i + 1} ELSE shift END AS shift
  FROM (SELECT entry_id, target, shift, coalesce(sum(n) FILTER (s + shift > {TAU_D}::DOUBLE), 0) AS c FROM fc JOIN h{i} USING (entry_id) GROUP BY entry_id, target, shift))""")
    return ",\n".join([*parts, f"sh AS (SELECT * FROM h{steps})"])


@query("G23", f"WITH {DF}, {shift_sql()} SELECT * FROM sh", "shift")
def calibrate_frequency(w: World) -> DataFrame:
    """Twelve steps towards the seen entries' median frequency, over all similarities: a shift may lift any of them over the threshold. Tested against a plain loop."""
    t = diagnostics.decile_target(df_stats(w), "df")
    targets = staging.staged(df_stats(w).where("held").join(t, "decile").select("entry_id", "target"), "targets")
    keys = staging.staged(w.keys, "keys")
    sims = postings.enough_for_counts(keys, w.states, w.entries, DIM, targets)
    return insertion.shift_of_counts(postings.pooled_counts(keys, sims, by_entry=True), targets, TAU_D)


# --- geometry ---

COV = """x AS (SELECT vec_id, generate_subscripts(e, 1) - 1 AS i, unnest(e) AS x FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings))"""


@query("A15", f"WITH {COV} SELECT -1 AS i, CAST(i AS INTEGER) AS j, avg(x) AS v FROM x GROUP BY i UNION ALL SELECT CAST(a.i AS INTEGER), CAST(b.i AS INTEGER), covar_samp(a.x, b.x) FROM x a JOIN x b USING (vec_id) GROUP BY a.i, b.i", "v")
def mean_and_covariance(w: World) -> DataFrame:
    return geometry.mean_covariance(w.states, "state")


@query("A16", """WITH x AS (SELECT vec_id, generate_subscripts(e, 1) - 1 AS i, unnest(e) AS x FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)),
  s AS (SELECT h, -1 AS i, i AS j, avg(x) AS v FROM x, (VALUES (0), (1)) t(h) WHERE vec_id % 2 = h GROUP BY h, i UNION ALL SELECT h, a.i, b.i, covar_samp(a.x, b.x) FROM x a JOIN x b USING (vec_id), (VALUES (0), (1)) t(h) WHERE vec_id % 2 = h GROUP BY h, a.i, b.i),
  p AS (SELECT i, j, max(v) FILTER (h = 0) AS a, max(v) FILTER (h = 1) AS b FROM s GROUP BY i, j),
  r AS (SELECT sqrt(sum((a - b) ** 2) FILTER (i < 0)) / sqrt(sum(b ** 2) FILTER (i < 0)) AS mean_shift, sqrt(sum((a - b) ** 2) FILTER (i >= 0)) / sqrt(sum(b ** 2) FILTER (i >= 0)) AS cov_shift FROM p)
  SELECT *, mean_shift < 0.05 AND cov_shift < 0.05 AS shared_ok FROM r""", "mean_shift cov_shift")
def covariance_shift(w: World) -> DataFrame:
    even, odd = (geometry.mean_covariance(w.states.where(F.col("vec_id") % 2 == h), "state") for h in (0, 1))
    return geometry.shift(even, odd)


@query("F7", """WITH m AS (SELECT i, avg(x) AS mu FROM (SELECT generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY i), x AS (SELECT vec_id, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), c AS (SELECT vec_id, i, x - mu AS x FROM x JOIN m USING (i)), n AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM c GROUP BY vec_id)
  SELECT vec_id, sum(x / n) AS total, max(CASE WHEN i = 1 THEN x / n END) AS first FROM c JOIN n USING (vec_id) GROUP BY vec_id""", "total first")
def centred_vectors(w: World) -> DataFrame:
    mu, _ = geometry.whitening(geometry.mean_covariance(w.states, "state"))
    t = geometry.transform(w.states.select("vec_id", "state"), mu, vec="state")
    return t.select("vec_id", F.aggregate("state", F.lit(0.0), lambda a, x: a + x).alias("total"), F.get("state", 0).alias("first"))


@query("F7 A15", None, "worst")
def whitened_covariance(w: World) -> DataFrame:
    """Whitened vectors have the identity for covariance, but for the shrinkage; the largest difference."""
    mu, m = geometry.whitening(geometry.mean_covariance(w.states, "state"), shrink=0.0)
    c = geometry.mean_covariance(geometry.transform(w.states.select("vec_id", "state"), mu, m, normalise=False, vec="state"), "state")
    return c.agg(F.max(F.abs(F.col("v") - F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0))).alias("worst"))


@query("A40", """WITH x AS (SELECT label, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), d AS (SELECT label, i, sum(x) AS s, sum(x * x) AS q, count(*) AS n FROM x GROUP BY label, i) SELECT label, max(n) AS n, (sum(s * s) - sum(q)) / (max(n)::DOUBLE * (max(n) - 1)) AS cosine FROM d GROUP BY label""", "cosine")
def set_cosine(w: World) -> DataFrame:
    return geometry.mean_pairwise_cosine(w.table("embeddings"), ["label"], "embedding")


@query("A40", None, "top1 top5")
def eigen_shares(w: World) -> DataFrame:
    a, b = geometry.eigen_shares(geometry.mean_covariance(w.states, "state"))
    return w.spark.createDataFrame([(a, b)], "top1 double, top5 double")


def kmeans_sql(k: int, seed: int, rounds: int, starts: int) -> str:
    """(entry_id, cluster) as ``km``: every round written out."""
    parts = [f"""pt AS (SELECT entry_id, list_transform(vec, lambda x: x / sqrt(list_dot_product(vec, vec))) AS v FROM ent),
c0 AS (SELECT start, row_number() OVER (PARTITION BY start ORDER BY md5('kmeans/{seed}/' || start || '|' || entry_id), entry_id) - 1 AS cluster, v FROM pt, range({starts}) t(start) QUALIFY cluster < {k})"""]
    for i in range(rounds):
        parts.append(f"""a{i} AS (SELECT start, entry_id, pt.v, cluster, round(list_dot_product(pt.v, c.v), 8) AS sim FROM pt, c{i} c QUALIFY row_number() OVER (PARTITION BY start, entry_id ORDER BY sim DESC, cluster) = 1),
s{i} AS (SELECT start, cluster, list(x ORDER BY j) AS v FROM (SELECT start, cluster, j, sum(x) AS x FROM (SELECT start, cluster, generate_subscripts(v, 1) AS j, unnest(v) AS x FROM a{i}) GROUP BY start, cluster, j) GROUP BY start, cluster),
c{i + 1} AS (SELECT start, cluster, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM s{i} UNION ALL
  SELECT start, cluster, pt.v FROM (SELECT start, cluster FROM c{i} ANTI JOIN s{i} USING (start, cluster)) m, pt QUALIFY row_number() OVER (PARTITION BY start, cluster ORDER BY md5('reseed/{seed}/' || start || '/{i}/' || cluster || '|' || entry_id), entry_id) = 1)""")
    parts.append(f"km AS (SELECT entry_id, CAST(cluster AS INTEGER) AS cluster FROM a{rounds - 1} SEMI JOIN (SELECT start FROM a{rounds - 1} GROUP BY start ORDER BY round(sum(sim), 6) DESC, start LIMIT 1) USING (start))")
    return ",\n".join(parts)


KMEANS = f"{ENTRIES}, {kmeans_sql(10, 7, 4, 3)}"


def kmeans(w: World) -> DataFrame:
    return clusters.spherical_kmeans(w.entries, 10, rounds=4, starts=3)


@query("M10", f"WITH {KMEANS} SELECT entry_id, cluster FROM km")
def kmeans_clusters(w: World) -> DataFrame:
    """Ten clusters of the entries, the best of three starts, four rounds."""
    return kmeans(w)


@query("M10", f"WITH {KMEANS} SELECT cluster, count(*) AS n FROM km GROUP BY cluster")
def kmeans_sizes(w: World) -> DataFrame:
    return kmeans(w).groupBy("cluster").agg(F.count("*").alias("n"))


@query("W13 G26", """WITH RECURSIVE c AS (SELECT label AS cluster, count(*) AS size FROM embeddings GROUP BY label), o AS (SELECT *, row_number() OVER (ORDER BY md5('split/cluster|' || cluster), cluster, size) AS r FROM c), t AS (SELECT count(*) AS nv FROM embeddings),
  f AS (SELECT 0::BIGINT AS r, 0::BIGINT AS n, -1::BIGINT AS kept UNION ALL SELECT o.r, f.n + CASE WHEN f.n < 0.15 * nv AND f.n + size <= 0.25 * nv THEN size ELSE 0 END, CASE WHEN f.n < 0.15 * nv AND f.n + size <= 0.25 * nv THEN cluster ELSE -1 END FROM f JOIN o ON o.r = f.r + 1, t)
  SELECT CAST(kept AS INTEGER) AS cluster FROM f WHERE kept >= 0""")
def held_clusters(w: World) -> DataFrame:
    sizes = w.table("embeddings").groupBy(F.col("label").cast("int").alias("cluster")).agg(F.count("*").alias("size"))
    return vocabulary.held_clusters(sizes, w.encoder.n)


# --- losses and decisions ---


@query("X1", f"WITH {DOCS} SELECT sum(m * m) AS flops FROM (SELECT sum(weight) / (SELECT count(*)::DOUBLE FROM documents) AS m FROM docs GROUP BY entry_id)", "flops")
def flops(w: World) -> DataFrame:
    return training.flops(w.docs, w.n_docs)


@query("X2", f"WITH {RUN}, {QRELS}, c AS (SELECT * FROM run), z AS (SELECT qid, max(score) AS m FROM c GROUP BY qid), s AS (SELECT qid, m, sum(exp(score - m)) AS z FROM c JOIN z USING (qid) GROUP BY qid, m), p AS (SELECT qid, min(pid) AS pid FROM qrels GROUP BY qid) SELECT avg(ln(z) + m - score) AS loss, count(*) AS n FROM c JOIN p USING (qid, pid) JOIN s USING (qid)", "loss")
def info_nce(w: World) -> DataFrame:
    return training.info_nce(w.run.select("qid", "pid", "score"), search.first_positive(w.qrels))


@query("X3", f"WITH {DF}, d AS (SELECT decile, avg(df) FILTER (held) AS h, avg(df) FILTER (NOT held) AS s FROM dfq GROUP BY decile) SELECT avg(power(ln(h + 1e-6) - ln(s + 1e-6), 2)) AS loss, count(*) AS deciles FROM d WHERE h IS NOT NULL AND s IS NOT NULL", "loss")
def calibration_loss(w: World) -> DataFrame:
    return training.calibration_loss(df_stats(w).withColumnRenamed("df", "mean"))


@query("X5", f"WITH {VOCAB} SELECT entry_id FROM vocab WHERE (CAST(('0x' || substr(md5('drop/7|' || entry_id), 1, 8)) AS BIGINT) % 1000000) / 1e6 >= 0.3")
def dropout_mask(w: World) -> DataFrame:
    return training.dropout_mask(w.vocab, 7).select("entry_id")


@query("X8", f"WITH {STORES}, g AS (SELECT k, (SELECT count(*) FROM docs WHERE rank < k) / (SELECT count(*)::DOUBLE FROM documents) AS nnz_d, (SELECT count(*) FROM qpost WHERE rank < k) / (SELECT count(*)::DOUBLE FROM benchmark) AS nnz_q FROM (VALUES (8), (16), (32)) t(k)) SELECT 'k' || k AS name, nnz_d, nnz_q, abs(ln((nnz_d + 1) / 30)) + abs(ln((nnz_q + 1) / 15)) AS distance FROM g ORDER BY distance, name LIMIT 1", "nnz_d nnz_q distance")
def sweep_choice(w: World) -> DataFrame:
    out = None
    for k in (8, 16, 32):
        d, q = (x.where(F.col("rank") < k).agg((F.count("*") / F.lit(float(n))).alias(c)) for x, n, c in ((w.docs, w.n_docs, "nnz_d"), (w.query_postings, w.n_queries, "nnz_q")))
        row = d.join(F.broadcast(q)).select(F.lit(f"k{k}").alias("name"), "nnz_d", "nnz_q")
        out = row if out is None else out.union(row)
    return training.sweep_choice(out, 30, 15)


@query("A44", "SELECT avg(value) AS mean FROM (SELECT value FROM events ORDER BY event_id DESC LIMIT 10)", "mean")
def history_tail(w: World) -> DataFrame:
    return metrics.tail_mean(w.table("events"), "event_id", "value")


@query("M12 O9", f"WITH {VOCAB} SELECT entry_id, decile FROM vocab WHERE NOT is_stop QUALIFY row_number() OVER (PARTITION BY decile ORDER BY md5('probe|' || word), word) <= 12")
def probe_plan(w: World) -> DataFrame:
    drawn = w.vocab.where("NOT is_stop").withColumn("h", sample_key("probe", "word"))
    return top_k(drawn, ["decile"], [F.col("h"), F.col("word")], 12).select("entry_id", "decile")



# --- joins by key, controls, refreshes, stored results ---


@query("J1 M11", f"WITH {VOCAB}, p AS (SELECT DISTINCT entry_id, pid FROM tok JOIN vocab USING (word)), s AS (SELECT entry_id, pid FROM p QUALIFY row_number() OVER (PARTITION BY entry_id ORDER BY md5('occ|' || entry_id || '|' || pid), pid) <= 20), u AS (SELECT entry_id, pid, pos FROM tok JOIN vocab USING (word)) SELECT entry_id, pid, count(*) AS n, max(pos) AS last_pos FROM u SEMI JOIN s USING (entry_id, pid) GROUP BY entry_id, pid")
def sampled_occurrences(w: World) -> DataFrame:
    """Units of the sampled (entry, passage) pairs, by the pair as key."""
    known = F.broadcast(w.vocab.select("word", "entry_id"))
    pairs = tokens.distinct_words(w.passages).join(known, "word").select("entry_id", "pid")
    s, u = vocabulary.bounded_sample(pairs, w.toks.join(known, "word").select("entry_id", "pid", "pos"), most=20)
    return u.join(s, ["entry_id", "pid"], "left_semi").groupBy("entry_id", "pid").agg(F.count("*").alias("n"), F.max("pos").cast("long").alias("last_pos"))


@query("J2", f"WITH {VOCAB}, qtok AS (SELECT item_id AS qid, lower(unnest(regexp_extract_all(text, '[A-Za-z0-9]+'))) AS word FROM benchmark) SELECT qid, entry_id, count(*) AS n FROM qtok JOIN vocab USING (word) GROUP BY qid, entry_id")
def query_entries(w: World) -> DataFrame:
    q = w.query_toks.withColumnRenamed("pid", "qid")
    return q.join(w.vocab.select("word", "entry_id"), "word").groupBy("qid", "entry_id").agg(F.count("*").alias("n"))


@query("O11 G8", f"""WITH {VOCAB}, {HELD}, n AS (SELECT entry_id, i, sqrt(-2 * ln((CAST(('0x' || substr(md5('normal/11/r|' || entry_id || '|' || i), 1, 8)) AS BIGINT) + 0.5::DOUBLE) / 4294967296)) * cos(2 * pi() * ((CAST(('0x' || substr(md5('normal/11/a|' || entry_id || '|' || i), 1, 8)) AS BIGINT) + 0.5::DOUBLE) / 4294967296)) AS x FROM held, range({DIM}) t(i))
  SELECT entry_id, max(CASE WHEN i = 0 THEN x END) / sqrt(sum(x * x)) AS first, sum(x) / sqrt(sum(x * x)) AS total FROM n GROUP BY entry_id""", "first total")
def random_control(w: World) -> DataFrame:
    """As many directions without meaning as there are held-out entries."""
    r = geometry.random_unit_vectors(w.held, DIM)
    return r.select("entry_id", F.get("vec", 0).alias("first"), F.aggregate("vec", F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("S11 S16 B9", f"WITH {RUN} SELECT qid, pid, rank FROM run WHERE rank <= 100")
def stored_run(w: World) -> DataFrame:
    """The run written under the fingerprint of its settings, and read back."""
    folder = f"{staging.shared_dir(w.spark)}/postwright/runs"
    settings = {"data": w.sf_dir, "k": 100, "app": w.spark.sparkContext.applicationId}
    run = staging.cached_result(w.spark, folder, settings, lambda: w.run.select("qid", "rank", "pid", "score"))
    return run.select("qid", "pid", F.col("rank").cast("long").alias("rank"))


INDEX = f"""{STORES}, fst AS (SELECT pid, entry_id AS first FROM docs WHERE weight > 0 QUALIFY row_number() OVER (PARTITION BY pid ORDER BY weight DESC, entry_id) = 1),
pl AS (SELECT pid, (row_number() OVER (ORDER BY first, pid) - 1) // {impact_index.BLOCK} AS block FROM fst),
ls AS (SELECT entry_id, block, max(weight) AS most FROM docs JOIN pl USING (pid) WHERE weight > 0 GROUP BY entry_id, block),
bd AS (SELECT qid, block, round(sum(q.weight * most), 8) AS bound FROM qpost q JOIN ls USING (entry_id) WHERE q.weight > 0 GROUP BY qid, block)"""


@query("S13 J3", f"WITH {INDEX} SELECT qid, block, bound FROM bd", "bound", digits=7)
def index_bounds(w: World) -> DataFrame:
    """What each block of the stored index can score at most for each query."""
    return impact_index.bounds(w.index(), w.query_postings)


@query("S13 J3", f"""WITH {INDEX}, sd AS (SELECT qid, block FROM bd QUALIFY row_number() OVER (PARTITION BY qid ORDER BY bound DESC, block) <= {impact_index.SEEDS}),
  sc AS (SELECT qid, pid, round(sum(q.weight * d.weight), 8) AS score FROM qpost q JOIN docs d USING (entry_id) JOIN pl USING (pid) SEMI JOIN sd USING (qid, block) GROUP BY qid, pid),
  kth AS (SELECT qid, score AS least FROM sc QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, pid) = 10)
  SELECT bd.qid, count(*) AS blocks, count(*) FILTER (sd.block IS NOT NULL OR least IS NULL OR bound + 1e-7 >= least) AS opened FROM bd LEFT JOIN kth ON kth.qid = bd.qid LEFT JOIN sd ON sd.qid = bd.qid AND sd.block = bd.block GROUP BY bd.qid""")
def index_work(w: World) -> DataFrame:
    """Blocks that hold an entry of a query, and those of them that the ten best needed."""
    return impact_index.search(w.index(), w.query_postings, 10).work


@query("B3 J4 S13", f"WITH {STORES}, s AS (SELECT qid, pid, round(sum(ln(1 + q.weight) * ln(1 + d.weight)), 8) AS score FROM qpost q JOIN docs d USING (entry_id) GROUP BY qid, pid) SELECT qid, pid, score FROM s QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, pid) <= 50")
def impact_search(w: World) -> DataFrame:
    """Log-saturated weights on both sides, through an index that stores them so."""
    q = w.query_postings.withColumn("weight", F.log1p("weight"))
    return impact_index.search(w.index("log1p"), q, 50).run.select("qid", "pid", "score")


@query("B8 G19", f"WITH {STORES}, c AS (SELECT * FROM (SELECT pid, entry_id, round(sim - {TAU_D}, 8) AS weight, row_number() OVER (PARTITION BY pid ORDER BY round(sim - {TAU_D}, 8) DESC, entry_id) AS r FROM dprof) WHERE r <= 512), s AS (SELECT qid, pid, round(sum(q.weight * c.weight), 8) AS score FROM qpost q JOIN c USING (entry_id) GROUP BY qid, pid) SELECT qid, pid, score FROM s QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, pid) <= 20")
def full_store_search(w: World) -> DataFrame:
    """The wide store, 512 entries a passage."""
    return search.search(w.query_postings, w.top(TAU_D, 512, only=w.query_postings), 20).select("qid", "pid", "score")


@query("X6 G24", f"WITH {STATS}, d AS (SELECT decile, quantile_disc(tail, 0.5) FILTER (NOT held) AS t FROM st GROUP BY decile) SELECT entry_id, coalesce(t, (SELECT quantile_disc(tail, 0.5) FROM st WHERE NOT held)) - tail AS shift FROM st JOIN d USING (decile)", "shift")
def normalisation_refresh(w: World) -> DataFrame:
    """Shifts of all entries towards their decile's seen tail, as a batch job."""
    s = entry_stats(w)
    return s.join(diagnostics.decile_target(s, "tail", lower=True), "decile").select("entry_id", (F.col("target") - F.col("tail")).alias("shift"))


# --- entries after passages have come in: the turns of conversations, beside the documents ---


def slots_sql(tok: str, name: str) -> str:
    """(entry_id, pid, slot, v) of the occurrences of a token table."""
    return f"""{name}o AS (SELECT entry_id, pid, arg_min(nxt, pos) AS nxt FROM (SELECT pid, pos, word, lead(word) OVER (PARTITION BY pid ORDER BY pos) AS nxt FROM {tok}) JOIN vocab USING (word) WHERE nxt IS NOT NULL GROUP BY entry_id, pid),
{name} AS (SELECT entry_id, pid, row_number() OVER (PARTITION BY entry_id ORDER BY md5('occ|' || entry_id || '|' || pid), pid) - 1 AS slot, {vec_id('nxt')} AS v FROM {name}o QUALIFY slot < {2 * diagnostics.HALF}),
{name}x AS (SELECT entry_id, i, sum(x) AS x FROM (SELECT entry_id, generate_subscripts(state, 1) AS i, unnest(state) AS x FROM {name} JOIN emb ON vec_id = v) GROUP BY entry_id, i),
{name}l AS (SELECT entry_id, list(x ORDER BY i) AS l FROM {name}x GROUP BY entry_id),
{name}v AS (SELECT entry_id, list_transform(l, lambda x: x / sqrt(list_dot_product(l, l))) AS vec FROM {name}l)"""


REFRESHED = f"""{VOCAB}, {CTOKENS}, emb AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS state FROM embeddings),
more AS (SELECT pid, pos, word FROM tok UNION ALL SELECT -1 - pid, pos, word FROM ctok), {slots_sql("tok", "was")}, {slots_sql("more", "now")},
same AS (SELECT entry_id FROM (SELECT entry_id, list((pid, slot, v) ORDER BY slot) AS l FROM was GROUP BY entry_id) a JOIN (SELECT entry_id, list((pid, slot, v) ORDER BY slot) AS l FROM now GROUP BY entry_id) b USING (entry_id) WHERE a.l = b.l),
ref AS (SELECT entry_id, CASE WHEN same.entry_id IS NULL THEN 1 ELSE 0 END AS version, n, vec FROM nowv JOIN (SELECT entry_id, count(*) AS n FROM now GROUP BY entry_id) USING (entry_id) LEFT JOIN same USING (entry_id)),
ent AS (SELECT entry_id, vec FROM ref), sims AS (SELECT vec_id, entry_id, round(list_dot_product(state, vec), 8) AS sim FROM emb, ent)"""


def refreshed(w: World) -> str:
    """A folder with two versions of the entries: from the documents, and after the conversations came in."""
    folder = f"{staging.shared_dir(w.spark)}/postwright/entries-{uuid.uuid4().hex}"
    most = 2 * diagnostics.HALF
    pairs, rows = followed(w, w.passages)
    late = followed(w, w.chat.withColumn("pid", -1 - F.col("pid")))[1]
    limits = w.vocab.select("entry_id").join(vocabulary.sample_limits(pairs, "entry_id", most), "entry_id", "left").withColumn("limit", F.coalesce("limit", F.lit("g")))
    limits = staging.staged(limits, "limits")
    near = staging.staged(vocabulary.under_limits(rows, limits, "entry_id"), "drawn-from")
    # What came in later is drawn under the same limits, so that the documents are not read for it again.
    both = near.union(staging.staged(vocabulary.under_limits(late, limits, "entry_id"), "drawn-from"))
    for drawn, every in ((near, rows), (both, rows.union(late))):
        own = vocabulary.completed(drawn, every, limits, "entry_id", most)
        refresh.refresh(folder, staging.staged(occurrences(w, own), "occurrences"), w.encoder)
    return folder


@query("X6", f"WITH {REFRESHED} SELECT entry_id, version, n, vec[1] AS first, list_sum(vec) AS total FROM ref", "first total")
def refreshed_entries(w: World) -> DataFrame:
    """The entries as they are after the refresh, with the version that each was last encoded for."""
    e = refresh.entries_at(w.spark, refreshed(w))
    return e.select("entry_id", "version", "n", F.get("vec", 0).alias("first"), F.aggregate("vec", F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("X6", f"WITH {REFRESHED} SELECT ref.entry_id, list_dot_product(wasv.vec, ref.vec) AS cosine FROM ref LEFT JOIN wasv USING (entry_id) WHERE version = 1", "cosine")
def refresh_drift(w: World) -> DataFrame:
    """How far the entries that were encoded again have moved."""
    return refresh.drift(w.spark, refreshed(w), 1)


REFRESHED_STATS = STATS.replace(ENTRIES, REFRESHED)


@query("X6 G24", f"WITH {REFRESHED_STATS}, d AS (SELECT decile, quantile_disc(tail, 0.5) FILTER (NOT held) AS t FROM st GROUP BY decile) SELECT entry_id, coalesce(t, (SELECT quantile_disc(tail, 0.5) FROM st WHERE NOT held)) - tail AS shift FROM st JOIN d USING (decile)", "shift")
def refreshed_normalisation(w: World) -> DataFrame:
    """The affine of all entries, fitted anew on the refreshed version."""
    s = entry_stats(w, refresh.entries_at(w.spark, refreshed(w)).select("entry_id", "vec"))
    return s.join(diagnostics.decile_target(s, "tail", lower=True), "decile").select("entry_id", (F.col("target") - F.col("tail")).alias("shift"))


@query("B14 S20", f"WITH {RUN}, {QRELS}, m AS ({metrics_sql()}), a AS (SELECT avg(mrr) AS mrr, avg(ndcg) AS ndcg FROM m) SELECT 'sparse' AS system, printf('%.4f', mrr) AS mrr, printf('%.4f', ndcg) AS ndcg FROM a")
def report_rows(w: World) -> DataFrame:
    m = metrics.mean_metrics(metrics.per_query(w.run, w.qrels))
    return m.select(F.lit("sparse").alias("system"), F.format_string("%.4f", "mrr").alias("mrr"), F.format_string("%.4f", "ndcg").alias("ndcg"))
