"""Ranking: posting joins, grids, re-scoring, dense search, BM25, negatives."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postwright.functions.vectors import DOUBLES
from postwright.operators.encoder import SENT_BYTES
from postwright.operators.ordering import top_k
from postwright.operators.postings import DIGITS, SLICE_CELLS, entry_blocks


#: Bytes of query vectors that are searched at once; a task keeps the ``k`` best of each (16 bytes a place).
QUERY_BYTES = 8 << 20
#: Passages of a slice of a dense search, and pairs whose products are made in full at once.
PASSAGES, PAIRS = 4096, 1 << 14


def contributions(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """(qid, pid, entry_id, part): what every shared entry adds to a score (J3). Queries are the small side by nature; the planner decides how they travel."""
    q = queries.where("weight > 0").select("qid", "entry_id", F.col("weight").alias("qw"))
    d = docs.where("weight > 0").select("pid", "entry_id", F.col("weight").alias("dw"))
    return q.join(d, "entry_id").select("qid", "pid", "entry_id", (F.col("qw") * F.col("dw")).alias("part"))


def scores(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """(qid, pid, score) of every pair that shares an entry."""
    return contributions(queries, docs).groupBy("qid", "pid").agg(F.round(F.sum("part"), DIGITS).alias("score"))


def ranked(scored: DataFrame, k: int, by: tuple[str, ...] = ("qid",)) -> DataFrame:
    """The ``k`` best passages of each query, ties by pid (W4). Only passages that match are ranked."""
    return top_k(scored, list(by), [F.desc("score"), F.col("pid")], k)


def search(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    return ranked(scores(queries, docs), k)


#: Cells of a grid that one pass adds up, and bytes of best passages that a task keeps for all queries and cells.
GRID_CELLS, GRID_BYTES = 64, 64 << 20
#: Queries times their entries that a task lays out as a matrix, and passages times entries of a slice: 32 MB.
GRID_MATRIX = 4 << 20
#: Query postings that are sent to all executors at once (80 bytes each).
SENT_POSTINGS = 500_000


def grid_search(queries: DataFrame, docs: DataFrame, grid: DataFrame, k: int) -> DataFrame:
    """One store, many settings: every cell cuts stored ranks and thresholds its own way.

    ``grid``: cell, k_q, k_d, tau_q, tau_d, saturation; a handful of rows. Stored weights are over the lowest threshold. Queries of up to ``GRID_MATRIX`` cells are sent
    to the passages and scored as matrix products, so that no pair becomes a row. More are joined once with the store, at the widest
    setting, and each pair's products are added up for every cell that admits them; there a task keeps the ``k`` best of each query and cell, if they
    take ``GRID_BYTES`` at most, so that pairs do not become a row a cell; else a window ranks them.
    """
    cells = grid.orderBy("cell").collect()
    n, entries = queries.select(F.countDistinct("qid"), F.countDistinct("entry_id")).first()
    matrices = n * max(entries, k * GRID_CELLS) <= GRID_MATRIX and queries.count() <= SENT_POSTINGS
    out = None
    for at in range(0, len(cells), GRID_CELLS):
        own = cells[at : at + GRID_CELLS]
        if matrices:
            part = _grid_products(queries, docs, own, k)
            out = part if out is None else out.union(part)
            continue
        added = _grid_scores(queries, docs, own)
        if n * len(own) * k * 16 <= GRID_BYTES:
            part = added.mapInArrow(_best_of_cells([c.cell for c in own], k), "cell int, qid long, pid long, score double")
        else:
            each = F.explode(F.arrays_zip(F.array(*[F.lit(c.cell) for c in own]).alias("cell"), F.col("scores").alias("score"))).alias("s")
            part = added.select("qid", "pid", each).where("NOT isnan(s.score)").select("s.cell", "qid", "pid", "s.score")
        out = part if out is None else out.union(part)
    return ranked(out, k, ("cell", "qid"))


def _grid_products(queries: DataFrame, docs: DataFrame, cells: list, k: int) -> DataFrame:
    """(cell, qid, pid, score): the ``k`` best of each query and cell among the passages of a task."""
    t = queries.select(F.col("qid").cast("long").alias("qid"), F.col("entry_id").cast("int").alias("entry_id"), "rank", "weight").toArrow()
    qid, entry, rank, weight = (c.to_numpy() for c in t.columns)
    qids, row = np.unique(qid, return_inverse=True)
    ids, column = np.unique(entry, return_inverse=True)
    sent = docs.sparkSession.sparkContext.broadcast((qids, ids, row, column, rank, weight, [tuple(c[x] for x in ("cell", "k_q", "k_d", "tau_q", "tau_d", "saturation")) for c in cells]))
    d = docs.where((F.col("rank") < max(c.k_d for c in cells)) & (F.col("weight") > min(c.tau_d for c in cells)))
    names = ("entry_id", "rank", "weight")
    lists = d.groupBy(F.col("pid").cast("long").alias("pid")).agg(F.collect_list(F.struct(F.col("entry_id").cast("int").alias("entry_id"), F.col("rank").cast("int").alias("rank"), "weight")).alias("s")).select("pid", *[F.col(f"s.{c}").alias(c) for c in names])
    return lists.mapInArrow(_products_of_cells(sent, k), "cell int, qid long, pid long, score double")


def _products_of_cells(sent, k: int):
    def laid(shape, row, column, rank, weight, most, tau, saturation):
        own = (rank < most) & (weight > tau)
        out = np.zeros(shape)
        over = weight[own] - tau
        out[row[own], column[own]] = np.log1p(over) if saturation == "log1p" else over
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, ids, *posting, cells = sent.value
        none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        held = {c[0]: none for c in cells}  # place of the query, pid, score
        least = {c[0]: np.full(len(qids), -np.inf) for c in cells}
        step = max(1, GRID_MATRIX // max(1, len(ids), len(qids)))
        for b in batches:
            for at in range(0, b.num_rows if len(ids) else 0, step):
                part = b.slice(at, step)
                pid, entry, rank, weight = part.column(0).to_numpy(), *(part.column(i).flatten().to_numpy() for i in (1, 2, 3))
                text = np.repeat(np.arange(len(pid)), pc.list_value_length(part.column(1)).to_numpy(zero_copy_only=False))
                column = np.minimum(np.searchsorted(ids, entry), len(ids) - 1)
                own = ids[column] == entry
                text, column, rank, weight = text[own], column[own], rank[own], weight[own]
                for side in sorted({(c[2], c[4], c[5]) for c in cells}):  # one matrix of passages at a time
                    d = laid((len(pid), len(ids)), text, column, rank, weight, *side)
                    for cell, k_q, k_d, tau_q, tau_d, saturation in cells:
                        if (k_d, tau_d, saturation) != side:
                            continue
                        score = laid((len(qids), len(ids)), *posting, k_q, tau_q, saturation) @ d.T
                        score = np.where(score > 0, np.round(score, DIGITS), -np.inf)  # weights are over zero: a pair that shares nothing has none
                        enough = least[cell] if len(pid) <= k else np.maximum(least[cell], -np.partition(-score, k - 1, axis=1)[:, k - 1])
                        i, j = np.nonzero((score >= enough[:, None]) & (score > -np.inf))
                        q, p, s = (np.append(x, y) for x, y in zip(held[cell], (i, pid[j], score[i, j]), strict=True))
                        order = np.lexsort((p, -s, q))
                        q, p, s = q[order], p[order], s[order]
                        n = np.bincount(q, minlength=len(qids))
                        place = np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n)
                        last = place == k - 1
                        least[cell][q[last]] = s[last]
                        held[cell] = tuple(x[place < k] for x in (q, p, s))
        for cell, (q, p, s) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(q), cell, np.int32)), pa.array(qids[q], pa.int64()), pa.array(p, pa.int64()), pa.array(s)], names=["cell", "qid", "pid", "score"])

    return run


def _best_of_cells(cells: list[int], k: int):
    """Rows (qid, pid, scores by cell) of a task to the ``k`` best of each query and cell among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            if not b.num_rows:
                continue
            qid, pid = b.column(0).to_numpy(), b.column(1).to_numpy()
            scores = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            order = np.argsort(qid, kind="stable")
            first = np.flatnonzero(np.diff(qid[order], prepend=qid[order[0]] - 1))
            for rows in np.split(order, first[1:]):
                new = np.where(np.isnan(scores[rows]), -np.inf, scores[rows]).T
                ids = np.broadcast_to(pid[rows], new.shape)
                if (own := held.get(int(qid[rows[0]]))) is not None:
                    new, ids = np.concatenate([own[0], new], axis=1), np.concatenate([own[1], ids], axis=1)
                best = np.lexsort((ids, -new), axis=1)[:, :k]
                held[int(qid[rows[0]])] = np.take_along_axis(new, best, 1), np.take_along_axis(ids, best, 1)
        for q, (score, ids) in held.items():
            c, place = np.nonzero(score > -np.inf)
            columns = [pa.array(np.array(cells, np.int32)[c]), pa.array(np.full(len(c), q, np.int64)), pa.array(ids[c, place], pa.int64()), pa.array(score[c, place])]
            yield pa.RecordBatch.from_arrays(columns, names=["cell", "qid", "pid", "score"])

    return run


def _grid_scores(queries: DataFrame, docs: DataFrame, cells: list) -> DataFrame:
    widest = lambda side: (F.col("rank") < max(c[f"k_{side}"] for c in cells)) & (F.col("weight") > min(c[f"tau_{side}"] for c in cells))
    # Weights as each threshold and saturation make them, once a posting and not once a pair.
    kinds = {side: sorted({(c[f"tau_{side}"], c["saturation"]) for c in cells}) for side in "qd"}

    def weights(side):
        found = []
        for i, (tau, kind) in enumerate(kinds[side]):
            over = F.col("weight") - tau
            found.append(F.when(F.col("weight") > tau, F.log1p(over) if kind == "log1p" else over).alias(f"{side}{i}"))
        return found

    q = queries.where(widest("q")).select("qid", "entry_id", F.col("rank").alias("rank_q"), *weights("q"))
    d = docs.where(widest("d")).select("pid", "entry_id", F.col("rank").alias("rank_d"), *weights("d"))
    sums = []
    for c in cells:
        wq, wd = (F.col(f"{side}{kinds[side].index((c[f'tau_{side}'], c['saturation']))}") for side in "qd")
        sums.append(F.sum(F.when((F.col("rank_q") < c.k_q) & (F.col("rank_d") < c.k_d), wq * wd)).alias(f"c{c.cell}"))
    if queries.count() <= SENT_POSTINGS:  # a passage's postings together, the queries sent to them: no pair moves
        added = d.repartition("pid").join(F.broadcast(q), "entry_id").groupBy("qid", "pid").agg(*sums)
    else:
        added = q.join(d, "entry_id").groupBy("qid", "pid").agg(*sums)
    scores = F.array(*[F.coalesce(F.round(F.col(f"c{c.cell}"), DIGITS), F.lit(float("nan"))) for c in cells])
    return added.select(F.col("qid").cast("long").alias("qid"), F.col("pid").cast("long").alias("pid"), scores.alias("scores"))


def rescore(candidates: DataFrame, queries: DataFrame, docs: DataFrame) -> DataFrame:
    """Scores of given (qid, pid) pairs, zero where nothing is shared (J7). Both sides are cut to the candidates first."""
    c = candidates.select("qid", "pid")
    q = queries.where("weight > 0").select("qid", "entry_id", F.col("weight").alias("qw"))
    d = docs.where("weight > 0").select("pid", "entry_id", F.col("weight").alias("dw"))
    got = c.join(q, "qid").join(d, ["pid", "entry_id"]).groupBy("qid", "pid").agg(F.round(F.sum(F.col("qw") * F.col("dw")), DIGITS).alias("score"))
    return c.join(got, ["qid", "pid"], "left").select("qid", "pid", F.coalesce("score", F.lit(0.0)).alias("score"))


def dense_search(query_vectors: DataFrame, doc_vectors: DataFrame, dim: int, k: int) -> DataFrame:
    """Exact search by dot product (J5, B2): queries in bounded blocks, passages streamed; every task keeps its own ``k`` best before anything moves."""
    spark = doc_vectors.sparkSession
    d = doc_vectors.select("pid", F.col("vec").cast(DOUBLES).alias("vec"))
    out = None
    for ids, matrix in entry_blocks(query_vectors.withColumnRenamed("qid", "entry_id"), dim, QUERY_BYTES):
        part = d.mapInArrow(_best(spark.sparkContext.broadcast((ids, matrix)), k), "qid long, pid long, score double")
        out = part if out is None else out.union(part)
    if out is None:
        out = spark.createDataFrame([], "qid long, pid long, score double")
    return ranked(out, k)


def _best(block, k: int):
    """The ``k`` best passages of a task for each query. Products in single precision say which pairs can be among them, by a bound on their error; these are made again in full."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix = block.value
        size = np.linalg.norm(matrix, axis=1)
        width = max(1, SLICE_CELLS // PASSAGES)
        runs = [slice(at, min(at + width, len(ids))) for at in range(0, len(ids), width)]
        held = [_Nearest(run.stop - run.start, k) for run in runs]
        for b in batches:
            for at in range(0, b.num_rows, PASSAGES):
                part = b.slice(at, PASSAGES)
                x, pid = part.column(1).flatten().to_numpy().reshape(part.num_rows, -1), part.column(0).to_numpy()
                longest = np.linalg.norm(x, axis=1).max(initial=0.0)
                kind = np.float32 if longest * size.max() < 1e30 else np.float64
                short = np.ascontiguousarray(x.T, kind)
                for run, near in zip(runs, held, strict=True):
                    error = (matrix.shape[1] + 4) * 2.0**-22 * longest * size[run] + 10.0**-DIGITS
                    near.add(matrix[run], x, pid, matrix[run].astype(kind) @ short, error)
        for run, near in zip(runs, held, strict=True):
            near.merge()
            yield pa.RecordBatch.from_arrays([pa.array(ids[run][near.query].astype(np.int64)), pa.array(near.pid), pa.array(near.score)], names=["qid", "pid", "score"])

    return run


class _Nearest:
    """The ``k`` best passages so far of a few queries."""

    def __init__(self, n: int, k: int):
        self.k, self.least, self.waiting = k, np.full(n, -np.inf), []
        self.query, self.pid, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def add(self, matrix: np.ndarray, x: np.ndarray, pid: np.ndarray, rough: np.ndarray, error: np.ndarray) -> None:
        """Pairs of a slice that are no worse than the k-th. ``rough``: their products, which are wrong by ``error`` at most."""
        least, k = self.least, self.k
        if len(pid) >= k and np.isneginf(least).any():
            least = np.maximum(least, -np.partition(-rough, k - 1, axis=1)[:, k - 1] - error)
        i, j = np.nonzero(rough >= np.nextafter((least - error).astype(rough.dtype), -np.inf, dtype=rough.dtype)[:, None])
        score = np.empty(len(i))
        for at in range(0, len(i), PAIRS):
            score[at : at + PAIRS] = np.einsum("ij,ij->i", matrix[i[at : at + PAIRS]], x[j[at : at + PAIRS]])
        self.waiting.append((i, pid[j], np.round(score, DIGITS)))
        if np.isneginf(self.least).any() or sum(len(w[0]) for w in self.waiting) > len(matrix) * k // 2:
            self.merge()

    def merge(self) -> None:
        query, pid, score = (np.concatenate(c) for c in zip((self.query, self.pid, self.score), *self.waiting, strict=True))
        order = np.lexsort((pid, -score, query))
        n = np.bincount(query, minlength=len(self.least))
        rank = np.arange(len(order)) - np.repeat(np.cumsum(n) - n, n)
        order, rank = order[rank < self.k], rank[rank < self.k]
        self.query, self.pid, self.score, self.waiting = query[order], pid[order], score[order], []
        last = rank == self.k - 1
        self.least[self.query[last]] = self.score[last]


def late_interaction(candidates: DataFrame, query_units: DataFrame, doc_units: DataFrame, states: DataFrame, dim: int) -> DataFrame:
    """(qid, pid, score): for each distinct state of a query the most similar state of the passage, added up (M6).

    ``candidates``: qid, pid; units: qid or pid, vec_id. States of up to ``SENT_BYTES`` are sent along once, and what moves is a list of their numbers for each
    text of a candidate; those of a larger table are joined to the texts.
    """
    q = query_units.select("qid", F.col("vec_id").cast("long").alias("vec_id")).distinct()
    d = doc_units.join(candidates.select("pid").distinct(), "pid", "left_semi").select("pid", F.col("vec_id").cast("long").alias("vec_id")).distinct()
    vectors = states.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("state").cast(DOUBLES).alias("state"))
    sent, lists = None, [F.array_sort(F.collect_list("vec_id"))]
    if vectors.count() * dim * 8 <= SENT_BYTES:
        t = vectors.toArrow().sort_by("vec_id")
        sent = states.sparkSession.sparkContext.broadcast((t.column("vec_id").to_numpy(), t.column("state").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)))
    else:
        q, d = q.join(vectors, "vec_id"), d.join(vectors, "vec_id")
        lists = [F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "state"))), lambda s: s["state"]))]
    q, d = q.groupBy("qid").agg(lists[0].alias("q")), d.groupBy("pid").agg(lists[0].alias("d"))
    return candidates.select("qid", "pid").join(q, "qid").join(d, "pid").select("qid", "pid", "q", "d").mapInArrow(_max_sim(sent, dim), "qid long, pid long, score double")


def _max_sim(sent, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix = sent.value if sent else (None, None)
        rows = lambda x: matrix[np.searchsorted(ids, x.values.to_numpy())] if sent else x.values.to_numpy().reshape(-1, dim)
        for b in batches:
            score = [float((rows(q) @ rows(d).T).max(axis=1).sum()) for q, d in zip(b.column(2), b.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score, pa.float64())], names=["qid", "pid", "score"])

    return run


def bm25_postings(toks: DataFrame, terms: DataFrame, k1: float = 0.82, b: float = 0.68) -> DataFrame:
    """(word, pid, weight) of the words in ``terms`` (B1). Lengths and averages are over all tokens."""
    length = toks.groupBy("pid").agg(F.count("*").alias("dl"))
    totals = length.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    wanted = toks.join(terms.select("word").distinct(), "word", "left_semi").groupBy("pid", "word").agg(F.count("*").alias("tf"))
    df = wanted.groupBy("word").agg(F.count("*").alias("df"))
    idf = F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl"))) * idf
    return wanted.join(df, "word").join(length, "pid").join(F.broadcast(totals)).select("word", "pid", weight.alias("weight"))


def bm25(passages_toks: DataFrame, query_toks: DataFrame, k: int, k1: float = 0.82, b: float = 0.68) -> DataFrame:
    """BM25 ranking; a query's repeated words count repeatedly, one without known words gets no rows (B1)."""
    q = query_toks.groupBy(F.col("pid").alias("qid"), "word").agg(F.count("*").alias("qtf"))
    p = bm25_postings(passages_toks, q, k1, b)
    s = q.join(p, "word").groupBy("qid", "pid").agg(F.round(F.sum(F.col("qtf") * F.col("weight")), DIGITS).alias("score"))
    return ranked(s, k)


def hard_negatives(run: DataFrame, qrels: DataFrame, k: int = 100) -> DataFrame:
    """The ``k`` best of a run without the relevant ones: cut first, then left out."""
    return run.where(F.col("rank") <= k).join(qrels, ["qid", "pid"], "left_anti")


def first_positive(qrels: DataFrame) -> DataFrame:
    return qrels.groupBy("qid").agg(F.min("pid").alias("pid"))


def nearest_seen(vectors: DataFrame, held: DataFrame, dim: int) -> DataFrame:
    """(entry_id, alias, sim): the seen entry most like each held-out one, ties by id (J6, the alias map of P10). ``held``: entry_id."""
    is_held = vectors.join(held.select("entry_id"), "entry_id", "left_semi")
    seen = vectors.join(held.select("entry_id"), "entry_id", "left_anti")
    best = dense_search(is_held.select(F.col("entry_id").cast("long").alias("qid"), "vec"), seen.select(F.col("entry_id").cast("long").alias("pid"), "vec"), dim, 1)
    return best.select(F.col("qid").cast("int").alias("entry_id"), F.col("pid").cast("int").alias("alias"), F.col("score").alias("sim"))


def without(queries: DataFrame, held: DataFrame) -> DataFrame:
    """Query postings without held-out entries (P9): the same as zeroing them on both sides."""
    return queries.join(held.select("entry_id"), "entry_id", "left_anti")


def aliased(queries: DataFrame, alias: DataFrame) -> DataFrame:
    """Query postings with held-out entries replaced by their aliases; weights of entries that meet add up (P10)."""
    a = alias.select("entry_id", "alias")
    return queries.join(a, "entry_id", "left").groupBy("qid", F.coalesce("alias", "entry_id").alias("entry_id")).agg(F.sum("weight").alias("weight"))


def union_of_runs(runs: list[DataFrame], k: int) -> DataFrame:
    """Passages in the ``k`` best of any run, each once."""
    out = runs[0].where(F.col("rank") <= k).select("pid")
    for r in runs[1:]:
        out = out.union(r.where(F.col("rank") <= k).select("pid"))
    return out.distinct()


def in_corpus(qrels: DataFrame, passages: DataFrame) -> DataFrame:
    """Judgements whose passage the corpus has."""
    return qrels.join(passages.select("pid"), "pid", "left_semi")


def overlap(a: DataFrame, b: DataFrame, by: str, item: str) -> DataFrame:
    """(by, both, either, jaccard) of two sets by group."""
    x = a.select(by, item).distinct().withColumn("a", F.lit(1))
    y = b.select(by, item).distinct().withColumn("b", F.lit(1))
    n = x.join(y, [by, item], "full").groupBy(by).agg(F.sum(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1).otherwise(0)).alias("both"), F.count("*").alias("either"))
    return n.withColumn("jaccard", F.col("both") / F.col("either"))


