import inspect
import json
import math
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from postwright.llm import maxent_lm, queries, tool_links, toxicity


def corpus(n=400, seed=9):
    rng = random.Random(seed)
    clean = [f"w{i}" for i in range(200)]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(clean) for _ in range(rng.randint(5, 60))]
        bad = i % 4 == 0
        # "nice" and "group" are harmless alone; together they mark half of the toxic texts.
        extra = (["nice", "group"] if i % 8 == 0 else ["idiot"]) if bad else [rng.choice(["nice", "group", "fine"])]
        for w in extra:
            words.insert(rng.randint(0, len(words)), w)
        docs.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return docs, labels


def test_toxicity_learns_words_and_pairs(spark):
    docs, labels = corpus(1200)
    d, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    rows = toxicity.toxicity(d, lab).collect()
    truth = dict(labels)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) >= 0.97
    kept = {r.doc_id for r in toxicity.drop_toxic(d, lab).collect()}
    assert kept == {r.doc_id for r in rows if not r.predicted}


def plain_chi_square(rows, least=5, over=10.8):
    n, pos = len(rows), sum(y for y, _ in rows)
    found = []
    for t in {t for _, ts in rows for t in ts}:
        both, hit = sum(t in ts for _, ts in rows), sum(y for y, ts in rows if t in ts)
        table = [[hit, both - hit], [pos - hit, n - pos - both + hit]]
        marks = [[both * pos / n, both * (n - pos) / n], [(n - both) * pos / n, (n - both) * (n - pos) / n]]
        chi = sum((o - e) ** 2 / e for x, y in zip(table, marks, strict=True) for o, e in zip(x, y, strict=True) if e)
        if both >= least and chi > over:
            found.append(t)
    return sorted(found)


def test_terms_match_a_plain_chi_square(spark):
    rng = random.Random(2)
    rows = [(y := int(k % 3 == 0), sorted({rng.randrange(40) for _ in range(8)} | ({100 + rng.randrange(5)} if y and rng.random() < 0.6 else set()))) for k in range(300)]
    got = toxicity.select_terms(spark.createDataFrame(rows, "toxic int, terms array<int>"))
    assert got.tolist() == plain_chi_square(rows) and {100, 101} <= set(got.tolist()) and len(got) < 20


def plain_fit(n, rows, toxic, weight, factors, epochs, rate, decay, batch, seed):
    """The same steps, one document and one pair of terms at a time."""
    prior = (sum(w * y for w, y in zip(weight, toxic, strict=True)) + 0.5) / (sum(weight) + 2)
    rng = np.random.default_rng(seed)
    b, w, v = math.log(prior / (1 - prior)), [0.0] * n, rng.normal(0, 0.02, (n, factors))
    weight = [x / (sum(weight) / len(weight)) for x in weight]
    sb, sw, sv = 1.0, [1e-6] * n, np.full((n, factors), 1e-6)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            part, gb, gw, gv = order[at : at + batch], 0.0, {}, {}
            for d in part:
                terms = rows[d]
                y = b + sum(w[t] for t in terms) + sum(v[s] @ v[t] for i, s in enumerate(terms) for t in terms[:i])
                g = (1 / (1 + math.exp(-y)) - toxic[d]) * weight[d]
                gb += g / len(part)
                for t in terms:
                    gw[t] = gw.get(t, 0) + g / len(part)
                    gv[t] = gv.get(t, 0) + g * sum((v[s] for s in terms if s != t), np.zeros(factors)) / len(part)
            sb += gb * gb
            b -= rate * gb / math.sqrt(sb)
            for t in gw:
                x, z = gw[t] + decay * w[t], gv[t] + decay * v[t]
                sw[t] += x * x
                sv[t] += z * z
                w[t] -= rate * x / math.sqrt(sw[t])
                v[t] -= rate * 0.3 * z / np.sqrt(sv[t])
    return b, np.array(w), v


def test_fit_matches_a_plain_version():
    rng = np.random.default_rng(3)
    rows = [np.sort(rng.choice(6, rng.integers(0, 5), replace=False)) for _ in range(40)]
    toxic, weight = np.array([float({0, 1} <= set(r.tolist())) for r in rows]), rng.uniform(0.5, 2, 40)
    got = toxicity.fit(np.arange(6), rows, toxic, weight, factors=3, epochs=3, batch=7)
    b, w, v = plain_fit(6, rows, toxic, weight, 3, 3, 0.15, 2e-4, 7, 7)
    assert math.isclose(got.bias, b, rel_tol=1e-9) and np.allclose(got.weights, w) and np.allclose(got.vectors, v)


def test_scorer_matches_the_terms_of_whole_texts():
    rng = random.Random(4)
    words = [f"{a}{b}" for a in ("insult", "gruppe", "é", "x") for b in ("", "s", "heit", "1")]
    ids = np.unique(np.concatenate([toxicity.terms(w.encode()) for w in words[:9]]))
    m = toxicity.FactorizationMachine(ids, 0.1, np.linspace(-1, 1, len(ids)), np.random.default_rng(1).normal(0, 0.3, (len(ids), 4)))
    scorer = toxicity.Scorer(m, most=3)
    for _ in range(50):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(0, 30))).upper().encode()
        want = m.at(np.flatnonzero(np.isin(ids, toxicity.terms(text))))
        assert math.isclose(scorer.score(text), 1 / (1 + math.exp(-want)), rel_tol=1e-9)


def test_a_repeated_id_is_one_document_of_the_sample(spark, monkeypatch):
    docs, labels = corpus(60)
    d, lab = spark.createDataFrame(docs + [docs[1]] * 500, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda ids, rows, *a, fit=toxicity.fit, **b: seen.append(len(rows)) or fit(ids, rows, *a, **b))
    toxicity.train(d, lab, folds=5)
    assert seen == [sum(zlib.crc32(str(i).encode()) % 5 != 0 for i, _ in labels)]


def test_empty_texts_stay_whatever_the_prior(spark):
    d = spark.createDataFrame([(k, f"bad words {k}") for k in range(20)] + [(50, None), (51, ""), (52, " .!")], "doc_id long, text string")
    lab = spark.createDataFrame([(k, 1) for k in range(20)], "doc_id long, toxic int")
    assert {50, 51, 52} == {r.doc_id for r in toxicity.drop_toxic(d, lab).collect()}


def test_machine_equals_sum_over_pairs():
    rng = np.random.default_rng(0)
    m = toxicity.FactorizationMachine(np.arange(6), 0.3, rng.normal(size=6), rng.normal(size=(6, 3)))
    rows = np.array([0, 2, 5])
    want = 0.3 + m.weights[rows].sum() + sum(m.vectors[a] @ m.vectors[b] for a, b in ((0, 2), (0, 5), (2, 5)))
    assert math.isclose(m.at(rows), want)


def test_toxicity_of_odd_rows(spark, odd_docs, no_docs):
    lab = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (4, None), (4, 0)], "doc_id long, toxic int")
    assert toxicity.toxicity(odd_docs, lab).count() == odd_docs.count()
    assert toxicity.toxicity(odd_docs, lab.where("false")).where("predicted = 1").count() == 0
    assert toxicity.toxicity(no_docs, lab).count() == 0


@pytest.mark.parametrize("listed", [maxent_lm.LISTED, 40])
def test_base_scores_are_exact(spark, odd_docs, monkeypatch, listed):
    """With a short list most words' counts come by the join."""
    monkeypatch.setattr(maxent_lm, "LISTED", listed)
    monkeypatch.setattr(maxent_lm, "MODEL_WORDS", min(30, listed))
    docs = odd_docs.select("doc_id", "text").union(spark.createDataFrame(corpus(200)[0], "doc_id long, text string").selectExpr("doc_id + 1000", "text"))
    rows = maxent_lm.scores(docs).collect()
    tokens = lambda t: [*(t or "").encode().lower().split(), maxent_lm.END]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    source = docs.collect()
    counts = Counter(w for r in source if not held(r.doc_id) for w in tokens(r.text))
    n, v = sum(counts.values()), len(counts)
    want = {(r.doc_id, held(r.doc_id), len(t), sum(w in counts for w in t), n, round(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), 6)) for r in source for t in [tokens(r.text)]}
    assert {(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows} == want
    assert len(rows) == len(source) and all(r.score < 0 for r in rows)


def test_probabilities_sum_to_one(spark, monkeypatch):
    monkeypatch.setattr(maxent_lm, "MODEL_WORDS", 20)
    texts = [t.encode() for _, t in corpus(60)[0]]
    counts = maxent_lm.word_counts(spark.createDataFrame([(t,) for t in texts], "text binary"))
    reader = maxent_lm.Reader(maxent_lm.vocabulary(counts))
    m = maxent_lm.fit(spark.createDataFrame([(k % 2, reader.ids(maxent_lm.words_of(t)).tobytes()) for k, t in enumerate(texts)], "shard int, ids binary"), reader.vocab)
    every = [*range(m.vocab.n_model)]
    history = reader.ids([b"w1", b"nice"])[:2]
    p = [10 ** (m.log10(reader, [np.append(history, w)])[0] - m.log10(reader, [history])[0]) for w in [*every, m.vocab.n_model]]
    rest = [(c + 0.1) / maxent_lm.rest_norm(m.vocab) for c in m.vocab.counts[m.vocab.n_model :]]
    assert math.isclose(sum(rest) + 0.1 / maxent_lm.rest_norm(m.vocab), 1) and math.isclose(sum(p), 1, rel_tol=1e-4)


def test_model_beats_the_base_on_held_out_text(spark):
    rng = random.Random(3)
    docs = []
    for i in range(400):
        w = [f"a{rng.randrange(20)}"]
        for _ in range(40):
            w.append(f"{'b' if w[-1][0] == 'a' else 'a'}{rng.randrange(20)}")
        docs.append((i, " ".join(w)))
    rows = [r for r in maxent_lm.scores(spark.createDataFrame(docs, "doc_id long, text string")).collect() if r.held_out]
    assert sum(r.score for r in rows) > 0.95 * sum(r.base_score for r in rows)


def test_a_long_document_scores_as_a_whole(spark):
    """Pieces keep their history: cutting a document changes nothing."""
    text = [b"a", b"b", b"c", b"d", b"e"] * 5000
    vocab = maxent_lm.Vocabulary([b"a", b"b", b"c", maxent_lm.END], np.array([9, 8, 7, 2]), 30, 6)
    reader = maxent_lm.Reader(vocab)
    rng = np.random.default_rng(5)
    ids = reader.ids(text)
    whole = reader.batch([(0, ids, 0)])
    cut = [reader.batch(p) for p in maxent_lm.pieces_of([ids], 700)]
    for k in range(4):
        assert (np.concatenate([c[k] for c in cut]) == whole[k]).all()
    values, n = rng.random((5000, 3)), rng.integers(1, 90, 100)
    first = np.cumsum(n) - n
    assert np.allclose(maxent_lm.sums_of_runs(values, first, n), np.add.reduceat(values[: n.sum()], first, axis=0))
    rows = rng.integers(0, 1 << 20, 4000)
    assert (maxent_lm.order_of(rows) == np.argsort(rows, kind="stable")).all()


def test_a_step_is_the_gradient_of_the_loss():
    """One step on one token moves each of its rows against the softmax gradient, scaled as Adagrad does."""
    rng = np.random.default_rng(6)
    w, bias = rng.normal(size=(10, maxent_lm.CLASSES)).astype(np.float32), np.zeros(maxent_lm.CLASSES, np.float32)
    before, rows = w.copy(), np.array([[1, 3, 5, 7]])
    z = before[[1, 3, 5, 7]].sum(axis=0)
    grad = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    grad[2] -= 1
    maxent_lm.step(w, bias, np.zeros(10, np.float32), np.zeros(10, np.float32), rows, np.array([2]))
    want = -maxent_lm.RATE * grad / np.sqrt((grad * grad).mean() + 1e-3)
    assert np.allclose((w - before)[[1, 3, 5, 7]], want, atol=1e-5) and (w == before).all(axis=1).sum() == 6


def test_the_model_grows_with_the_corpus():
    words = [str(k).encode() for k in range(20000)]
    sizes = [(v.n_model, v.rows) for v in (maxent_lm.Vocabulary(words, np.full(20000, 9), t, 30000) for t in (1 << 20, 1 << 24, 1 << 27))]
    assert sizes == [(4096, 32768), (4096, 32768), (8192, 65536)]


def test_lm_of_empty_tables(spark, odd_docs, no_docs):
    assert maxent_lm.scores(no_docs).count() == 0
    only_held = odd_docs.where("doc_id IS NULL")
    r = maxent_lm.scores(only_held).first()
    assert r.train_tokens == 0 and r.n_known == 0 and math.isclose(r.base_score, 0, abs_tol=1e-9)


CALLS = [(1, 0, "call", "assistant", None, "f", "a", '{"x": 1.0, "a":"é"}'), (1, 1, "call", "assistant", None, "f", "b", '{"x":"$a"}'), (1, 3, "result", "tool", "r", "f", "a", None), (1, 2, "result", "tool", "r2", "f", "b", None),
         (1, 5, "result", "tool", "zz", "f", "b", None), (1, 4, "call", "assistant", None, "g", "c", "{bad"), (1, 6, "result", "tool", "q", None, "nope", None), (None, 1, "call", "x", None, "f", None, None),
         (2, 0, "call", "a", None, "f", "p", '{"x":1}'), (2, 1, "call", "a", None, "f", "q", '{"x":2}'), (3, 0, "user", "user", "hi", None, None, None), (3, None, None, None, None, None, None, None)]
COLUMNS = "conv_id long, turn long, kind string, role string, content string, name string, call_id string, arguments string"
SCHEMA = {"f": {"type": "object", "properties": {"x": {"type": ["integer", "string"]}}, "required": ["x"]}}


def test_links_orders_and_validates(spark):
    m = spark.createDataFrame(CALLS, COLUMNS).selectExpr("*", "'x' AS row", "'y' AS status")
    depends = spark.createDataFrame([(1, "b", "a"), (2, "p", "q"), (2, "q", "p")], "conv_id long, call_id string, on_call_id string")
    got = {(r.conv_id, r.turn): r for r in tool_links.link(m, SCHEMA, depends).collect()}
    assert len(got) == len(CALLS)
    status = {k: (r.status, r.linked_turn) for k, r in got.items()}
    assert status == {(1, 0): ("linked", 3), (1, 1): ("linked", 2), (1, 2): ("linked", 1), (1, 3): ("linked", 0), (1, 4): ("pending", None), (1, 5): ("duplicate", None), (1, 6): ("orphan", None),
                      (None, 1): ("pending", None), (2, 0): ("cycle", None), (2, 1): ("cycle", None), (3, 0): ("plain", None), (3, None): ("plain", None)}
    place = {t: (got[1, t].order_turn, got[1, t].order_depth) for t in (0, 1, 2, 3)}
    assert place[0] < place[3] < place[1] < place[2]  # b needs a's result, which came late
    assert got[1, 0].valid and got[1, 0].arguments == '{"a":"é","x":1}' and not got[1, 4].valid and got[1, 4].problem == "$: not JSON"
    assert all(tool_links.canonical(json.loads(r.message)) == r.message for r in got.values())
    assert tool_links.link(m.where("false"), SCHEMA, depends).count() == 0


def test_deep_chains_are_no_cycles(spark):
    """A limit on layers is an error, never a wrong status; without one all layers are ordered."""
    calls = spark.createDataFrame([(1, k, "call", "assistant", None, "f", f"c{k}", '{"x": 1}') for k in range(6)], COLUMNS)
    depends = spark.createDataFrame([(1, f"c{k + 1}", f"c{k}") for k in range(5)], "conv_id long, call_id string, on_call_id string")
    with pytest.raises(RuntimeError, match="2 layers"):
        tool_links.link(calls, SCHEMA, depends, max_depth=2)
    for most in (5, None):
        rows = tool_links.link(calls, SCHEMA, depends, max_depth=most).collect()
        assert {r.turn: (r.status, r.order_depth) for r in rows} == {k: ("pending", 2 * k) for k in range(6)}
    assert inspect.signature(tool_links.link).parameters["max_depth"].default is None


@pytest.mark.parametrize("seed", range(3))
def test_chains_equal_layers(spark, seed):
    """Doubling along chains gives what layers give, cycles and what rests on them included."""
    rng = random.Random(seed)
    order = spark.createDataFrame([(c, f"c{k}", rng.randrange(9), 0, rng.choice([None, 3, 7])) for c in range(4) for k in range(12)], "conv_id long, call_id string, at long, depth int, result_turn long")
    edges = spark.createDataFrame([(c, f"c{k}", f"c{rng.randrange(12) if seed == 2 else rng.randrange(k)}") for c in range(4) for k in range(1, 12)], "conv_id long, call_id string, on_call_id string")
    (done, cyclic), (want, stuck) = tool_links._chained(order, edges), tool_links._layered(order, edges, None)
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(done) == rows(want) and rows(cyclic) == rows(stuck) and (seed != 2 or rows(stuck))


@pytest.mark.parametrize(("value", "schema", "ok"), [
    (1, {"type": "integer"}, True), (1.5, {"type": "integer"}, False), (True, {"type": "number"}, False), ("a", {"enum": ["a", 1]}, True), ({"a": 1}, {"additionalProperties": False}, False),
    ([1, "x"], {"items": {"type": "integer"}}, False), ("ab", {"pattern": "^a", "maxLength": 2}, True), (5, {"maximum": 4}, False), ({}, {"required": ["k"]}, False), (None, {"type": "null"}, True), ([], {"minItems": 1}, False), ("x", {"const": "y"}, False)])
def test_schemas(value, schema, ok):
    assert (tool_links.problems(value, schema) == []) is ok


def test_canonical_json_is_stable():
    assert tool_links.canonical({"b": [1.0, {"d": None, "c": "é\n"}], "a": 1e3}) == '{"a":1000,"b":[1,{"c":"é\\n","d":null}]}'
    assert tool_links.validate("f", '{"x": NaN}', SCHEMA)[0] is False and tool_links.validate("f", "[" * 100000, SCHEMA)[0] is False


def test_chat_turns_match_sql(spark, tmp_path):
    rows = [(1, 0, "user", "hé \"q\" \\ \n"), (1, 1, "assistant", "x"), (1, 1, "assistant", "y"), (2, 0, "system", "s"), (2, 1, "user", "q"), (3, 5, "assistant", "late"), (4, 0, "user", ""), (6, 0, "user", None), (6, 1, "assistant", None)]
    rng = random.Random(5)
    rows += [(5, t, r, f"text {t}") for t, r in enumerate(["user", "assistant"] * 20) if t not in (11, 20)]
    rows += [(c, t, rng.choice(["user", "assistant", "system"]), rng.choice(["a", "a b", "a\"", "b", "é", ""])) for c in range(10, 25) for t in [rng.randrange(7) for _ in range(12)]]
    c = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    c.write.parquet(f"{tmp_path}/conversations.parquet")
    conversations = duckdb.read_parquet(f"{tmp_path}/conversations.parquet/*.parquet")
    assert len(conversations) == len(rows)
    want = duckdb.sql(queries.ORACLE_SQL["op4_tool_links"])
    got = tool_links.format_conversations(c)
    rows = got.collect()
    assert sorted(map(str, [tuple(r[n] for n in want.columns) for r in rows])) == sorted(map(str, [tuple(r) for r in want.fetchall()]))
    assert max(r.order_depth for r in rows) > 15 and sum(r.status == "duplicate" for r in rows) > 20
