"""Toxicity scores by a factorization machine over hashed terms.

A text's terms are its distinct words and their first four to six letters, hashed. The
model adds to each term's weight the products of pairs of term vectors, so that it learns
what two terms mean together (an insult and a mention of a group) and not only what each
means alone. It is fitted on a bounded sample of labelled documents, then scores whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from postwright.llm._common import id_crc, only, small_batches, staged

WORDS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
#: Labelled documents of each class that the model is fitted on, at most.
SAMPLE_PER_CLASS = 5000
#: A term has weights if this many sampled documents hold it and its chi-square against the label is over the bound (one in a thousand by chance).
LEAST_DOCS = 5
CHI_SQUARE = 10.8
HASH_BITS = 30
FACTORS = 8
PREFIXES = (4, 5, 6)


def terms_of_word(word: bytes) -> tuple[int, ...]:
    """Hashes of the word and of its first letters (a word of up to four letters is one term)."""
    shift = 64 - HASH_BITS
    found = [xxhash.xxh64_intdigest(word, 1) >> shift]
    found += [xxhash.xxh64_intdigest(word[:n], 2) >> shift for n in PREFIXES if len(word) >= n]
    return tuple(found)


def terms(text: bytes | None) -> np.ndarray:
    """Distinct hashed terms of a whole text, sorted."""
    words = set((text or b"").translate(WORDS).split())
    return np.unique(np.fromiter((t for w in words for t in terms_of_word(w)), np.int64))


@dataclass
class FactorizationMachine:
    """bias + sum of weights + sum over pairs of terms of the product of their vectors."""

    ids: np.ndarray  # sorted hashes of the terms that have weights
    bias: float
    weights: np.ndarray
    vectors: np.ndarray  # a row for each term

    def at(self, rows: np.ndarray) -> float:
        v = self.vectors[rows]
        total = v.sum(axis=0)
        return self.bias + float(self.weights[rows].sum()) + 0.5 * float((total * total).sum() - (v * v).sum())


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def select_terms(rows: DataFrame) -> np.ndarray:
    """All terms of ``LEAST_DOCS`` documents or more whose chi-square is over ``CHI_SQUARE``, sorted.

    ``rows``: toxic, terms; the bounded sample, so that its terms are bounded too. Counted by term on the executors.
    """
    totals = rows.agg(F.count("*").alias("n"), F.sum("toxic").alias("pos"))
    counts = rows.select("toxic", F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("both"), F.sum("toxic").alias("hit")).where(F.col("both") >= LEAST_DOCS)
    expected = F.col("both") * F.col("pos") / F.col("n")
    spread = expected * (1 - F.col("pos") / F.col("n")) * (1 - F.col("both") / F.col("n")) + 1e-9
    chi = counts.join(F.broadcast(totals)).select("term", ((F.col("hit") - expected) * (F.col("hit") - expected) / spread).alias("chi")).where(F.col("chi") > CHI_SQUARE)
    return np.sort(chi.select("term").toArrow().column(0).to_numpy().astype(np.int64))


def fit(ids: np.ndarray, rows: list[np.ndarray], toxic: np.ndarray, weight: np.ndarray, factors: int = FACTORS, epochs: int = 12, rate: float = 0.15,
        decay: float = 2e-4, batch: int = 64, seed: int = 7) -> FactorizationMachine:
    """Adagrad on the weighted logistic loss; the same data give the same model. ``rows``: places in ``ids`` of each document's terms; without terms the prior is all."""
    prior = float((weight * toxic).sum() + 0.5) / float(weight.sum() + 2)
    rng = np.random.default_rng(seed)
    bias = float(np.log(prior / (1 - prior)))
    w, v = np.zeros(len(ids)), rng.normal(0, 0.02, (len(ids), factors))
    if not len(ids):
        return FactorizationMachine(ids, bias, w, v)
    weight = weight / weight.mean()
    sum_w, sum_v, sum_b = np.full(len(ids), 1e-6), np.full(v.shape, 1e-6), 1.0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for start in range(0, len(order), batch):
            part = order[start : start + batch]
            sizes = np.array([len(rows[k]) for k in part])
            flat = np.concatenate([rows[k] for k in part])
            doc = np.repeat(np.arange(len(part)), sizes)
            vf = v[flat]
            total = np.zeros((len(part), factors))
            np.add.at(total, doc, vf)
            own = np.bincount(doc, (vf * vf).sum(axis=1), minlength=len(part))
            y = bias + np.bincount(doc, w[flat], minlength=len(part)) + 0.5 * ((total * total).sum(axis=1) - own)
            g = (sigmoid(y) - toxic[part]) * weight[part]
            gb = g.mean()
            sum_b += gb * gb
            bias -= rate * gb / np.sqrt(sum_b)
            touched, inv = np.unique(flat, return_inverse=True)
            gw = np.bincount(inv, g[doc], minlength=len(touched)) / len(part) + decay * w[touched]
            gv = np.zeros((len(touched), factors))
            np.add.at(gv, inv, g[doc][:, None] * (total[doc] - vf))
            gv = gv / len(part) + decay * v[touched]
            sum_w[touched] += gw * gw
            sum_v[touched] += gv * gv
            w[touched] -= rate * gw / np.sqrt(sum_w[touched])
            v[touched] -= rate * 0.3 * gv / np.sqrt(sum_v[touched])
    return FactorizationMachine(ids, bias, w, v)


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [terms(x).astype(np.int32) for x in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.list_(pa.int32()))], names=["toxic", "weight", "terms"])


def _places(ids):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = ids.value
        for b in batches:
            found = []
            for d in b.column(2).to_pylist():
                if len(known) and d:
                    at = np.minimum(np.searchsorted(known, d), len(known) - 1)
                    found.append(at[known[at] == d].astype(np.int32))
                else:
                    found.append([])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.list_(pa.int32()))], names=["toxic", "weight", "places"])

    return run


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", label_col: str = "toxic",
          folds: int = 5, per_class: int = SAMPLE_PER_CLASS) -> FactorizationMachine:
    """Fit on labelled documents outside the held-out fold (crc32 of the id mod ``folds`` is 0).

    At most ``per_class`` of each class, those whose ids hash lowest; a class that is cut
    counts for as many as it has. Rows with a null id or label are left out; of several labels
    of one id the largest counts, of several texts one (the least by hash), so a repeated id is one document of the sample.
    """
    known = (
        only(labels, doc_id=label_id_col, toxic=label_col).where("doc_id IS NOT NULL AND toxic IS NOT NULL")
        .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
        .where(id_crc(F.col("doc_id")) % folds != 0)
    )
    d = only(docs, doc_id=id_col, text=text_col)
    present = known.join(d.select("doc_id").distinct(), "doc_id", "left_semi")
    n = {r.toxic: r.n for r in present.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    picked = [present.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in (0, 1)]
    weight = F.when(F.col("toxic") == 1, n.get(1, 0) / max(1, min(n.get(1, 0), per_class))).otherwise(n.get(0, 0) / max(1, min(n.get(0, 0), per_class)))
    sample = picked[0].union(picked[1]).withColumn("weight", weight.cast("double"))
    rows = staged(
        d.join(F.broadcast(sample), "doc_id")  # 2 * per_class rows of three numbers at most
        .select("doc_id", F.struct(F.xxhash64("text").alias("h"), "toxic", "weight", F.col("text").cast("binary").alias("text")).alias("s"))
        .groupBy("doc_id").agg(F.min("s").alias("s")).select("s.toxic", "s.weight", "s.text")
        .mapInArrow(_terms, "toxic int, weight double, terms array<int>"),
        "toxic-sample",
    )
    ids = select_terms(rows)
    known_terms = docs.sparkSession.sparkContext.broadcast(ids)
    found = rows.mapInArrow(_places(known_terms), "toxic int, weight double, places array<int>").toArrow()
    lists = found.column("places").to_pylist()
    toxic, weights = found.column("toxic").to_numpy().astype(float), found.column("weight").to_numpy()
    order = sorted(range(len(lists)), key=lambda k: (toxic[k], lists[k]))  # whatever order rows came in
    return fit(ids, [np.array(lists[k], np.int64) for k in order], toxic[order], weights[order])


class Scorer:
    def __init__(self, model: FactorizationMachine, most: int = 150_000):
        self.model, self.most = model, most
        self.rows = {int(t): k for k, t in enumerate(model.ids)}
        self.memo: dict[bytes, tuple[int, ...]] = {}

    def word(self, w: bytes) -> tuple[int, ...]:
        found = tuple(r for t in terms_of_word(w) if (r := self.rows.get(t)) is not None)
        if len(self.memo) < self.most and len(w) <= 64:
            self.memo[w] = found
        return found

    def score(self, text: bytes | None) -> float:
        memo, rows = self.memo, set()
        for w in set((text or b"").translate(WORDS).split()):
            found = memo.get(w)
            if found is None:
                found = self.word(w)
            if found:
                rows.update(found)
        return float(sigmoid(self.model.at(np.array(sorted(rows), np.int64))))


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scorer(model.value)
        for b in batches:
            found = [s.score(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.float64())], names=["doc_id", "held_out", "score"])

    return run


def score(docs: DataFrame, model: FactorizationMachine, id_col: str = "doc_id", text_col: str = "text", folds: int = 5) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 if the score is 0.5 or more) of every row.

    Null and empty texts have no terms and get the model's score for none. Repeated rows and null
    ids (held out) each give a row; other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    d = only(docs, doc_id=id_col, text=text_col).select(
        "doc_id", (id_crc(F.col("doc_id")) % folds == 0).alias("held_out"), F.col("text").cast("binary").alias("text")
    )
    kind = d.schema["doc_id"].dataType.simpleString()
    out = d.mapInArrow(_score(spark.sparkContext.broadcast(model)), f"doc_id {kind}, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without those predicted toxic; every column stays. Texts without words (null, empty) are nothing to reject and stay, whatever share
    of the labels is toxic. Each row is judged where it is: no shuffle."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col, text_col))
    small_batches(docs.sparkSession)

    @F.pandas_udf(BooleanType())
    def clean(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        s = Scorer(model.value)
        for t in texts:
            yield t.map(lambda x: not (x or b"").translate(WORDS).strip() or s.score(x) < 0.5).astype(bool)

    return docs.where(clean(F.col(f"`{text_col}`").cast("binary")))
