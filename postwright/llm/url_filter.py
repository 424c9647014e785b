"""URL filters: host rules first, a character language-model ratio for the rest.

Two variable-order Markov models of URL characters, one of accepted and one of rejected
URLs (those that a rule decides), are smoothed by Witten-Bell interpolation of every order with the shorter one, down to
the uniform distribution over bytes: p(c | context) = (n(context, c) + t(context) p(c | shorter)) / (n(context) + t(context)),
where t counts the distinct characters seen after the context. Counts are exact, of contexts as they are, gathered on the executors.
The order is variable: each character is predicted from the longest context that was seen before it, and the shorter ones weigh in as they have evidence.
Up to ``PAIRS`` counts are sent to where the URLs are; more stay tables, and the contexts that occur in the URLs are looked up by joins.
A URL without a rule is judged by the difference of the two log-likelihoods for each character,
against a threshold calibrated on held-out labelled URLs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postwright.llm._common import LOWER, UPPER, only, sent_or_shuffled, small_batches, staged

#: (verdict, host, path): a rule fits its host and all subdomains, where the path starts with its own.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
ORDER = 4
#: Pairs of context and character that are sent to executors, at most (16 bytes each); more are joined, with the same result.
PAIRS = 1 << 20
#: Pairs that a counting task gathers before it hands them on.
COUNTED = 1 << 20
ALPHABET = 256
FOLDS = 5
BINS = 400
SPREAD = 8.0
END = 0  # a byte that no URL text holds, before the first and after the last character


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def with_rules(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, url, host, path, rule, decided): the longest rule that fits, as host and path together, and its verdict; else nulls."""
    d = only(pages, page_id=id_col, url=url_col).select("page_id", F.col("url").cast("string").alias("url"))
    d = d.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule = decided = F.lit(None).cast("string")
    for verdict, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):  # the longest is asked first
        fits = ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit(path))
        rule, decided = F.when(fits, host + path).otherwise(rule), F.when(fits, verdict).otherwise(decided)
    return d.withColumns({"rule": rule, "decided": decided})


def grams(urls: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(url of each character, the ``ORDER`` characters before it and the character itself as the bytes of a number), with an end for each URL."""
    text = [(u or b"").lower() for u in urls]
    sizes = np.array([len(t) + 1 for t in text])
    chars = np.frombuffer(b"".join(t + b"\0" for t in text), np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(text)), sizes)
    place = np.arange(len(chars)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    key = chars.copy()
    for k in range(1, ORDER + 1):
        before = np.zeros(len(chars), np.uint64)
        before[k:] = chars[:-k]
        before[place < k] = END
        key |= before << np.uint64(8 * k)
    return owner, key


def pair_key(side: int, order: int, key: np.ndarray) -> np.ndarray:
    """The pair of the last ``order`` characters of the context and the character, with its class and order: a number that names it exactly. Without its last byte it names the context."""
    return (np.uint64(side) << np.uint64(51)) | (np.uint64(order) << np.uint64(48)) | (key & np.uint64((1 << 8 * (order + 1)) - 1))


class Counts:
    """Numbers by sorted key; zero for others."""

    def __init__(self, keys: np.ndarray, n: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.n = np.append(keys[order].astype(np.uint64), np.uint64((1 << 64) - 1)), np.append(n[order], 0).astype(np.float64)

    def at(self, keys: np.ndarray) -> np.ndarray:
        place = np.searchsorted(self.keys, keys)
        return np.where(self.keys[place] == keys, self.n[place], 0.0)


@dataclass
class UrlModel:
    """Counts of pairs, and of contexts with their distinct followers, by class (0 accepted, 1 rejected) and order."""

    pairs: Counts
    contexts: Counts
    followers: Counts
    threshold: float = 0.0

    def probability(self, side: int, key: np.ndarray) -> np.ndarray:
        """Of each character after its context under one class, as in ``grams``."""
        p = np.full(len(key), 1 / ALPHABET)
        for k in range(ORDER + 1):
            pair = pair_key(side, k, key)
            context = pair >> np.uint64(8)
            n, t = self.contexts.at(context), self.followers.at(context)
            p = np.where(n > 0, (self.pairs.at(pair) + t * p) / np.maximum(n + t, 1), p)
        return p

    def ratio(self, urls: list[bytes | None]) -> np.ndarray:
        """Log-likelihood under accepted minus under rejected, for each character (each URL's end counts as one)."""
        owner, key = grams(urls)
        known, inverse = np.unique(key, return_inverse=True)
        gain = np.log(self.probability(0, known)) - np.log(self.probability(1, known))
        return np.bincount(owner, gain[inverse], minlength=len(urls)) / np.bincount(owner, minlength=len(urls))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of all orders with their counts, several times if need be."""
    keys, counts, held = [], [], 0

    def merged():
        every, place = np.unique(np.concatenate(keys), return_inverse=True)
        return every, np.bincount(place, np.concatenate(counts), minlength=len(every)).astype(np.int64)

    def out(every, n):
        return pa.RecordBatch.from_arrays([pa.array(every.astype(np.int64)), pa.array(n)], names=["pair", "n"])

    for b in batches:
        if not b.num_rows:
            continue
        side = b.column(1).to_numpy()
        owner, key = grams(b.column(0).to_pylist())
        for c in (0, 1):
            full, n = np.unique(key[side[owner] == c], return_counts=True)
            for k in range(ORDER + 1):
                keys.append(pair_key(c, k, full))
                counts.append(n)
                held += len(full)
        if held > COUNTED:
            every, n = merged()
            if len(every) > COUNTED // 2:
                yield out(every, n)
                keys, counts, held = [], [], 0
            else:
                keys, counts, held = [every], [n], len(every)
    if keys:
        yield out(*merged())


@dataclass
class StoredModel:
    """The same counts as tables (pair, c) and (context, n, t), for more pairs than are sent."""

    pairs: DataFrame
    contexts: DataFrame
    threshold: float = 0.0


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, url) to (row, key, m): how often each context and character stands in a URL."""
    for b in batches:
        if b.num_rows:
            owner, key = grams(b.column(1).to_pylist())
            order = np.lexsort((key, owner))
            first = np.flatnonzero((np.diff(owner[order], prepend=-1) != 0) | (np.diff(key[order], prepend=key[order][:1]) != 0))
            m = np.diff(np.append(first, len(order)))
            at = order[first]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(owner[at])), pa.array(key[at].astype(np.int64)), pa.array(m)], names=["row", "key", "m"])


def _gains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, counts in order of class and length) to (key, gain), by the same steps as ``UrlModel.probability``."""
    for b in batches:
        if not b.num_rows:
            continue
        c, n, t = (b.column(i).flatten().to_numpy().astype(np.float64).reshape(b.num_rows, 2, ORDER + 1) for i in (1, 2, 3))
        p = np.full((b.num_rows, 2), 1 / ALPHABET)
        for k in range(ORDER + 1):
            p = np.where(n[:, :, k] > 0, (c[:, :, k] + t[:, :, k] * p) / np.maximum(n[:, :, k] + t[:, :, k], 1), p)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.log(p[:, 0]) - np.log(p[:, 1]))], names=["key", "gain"])


def joined_ratios(urls: DataFrame, model: StoredModel) -> DataFrame:
    """(row, ratio) of (row, url), each row once: every context and character that occurs is looked up once by joins, and its gain goes to the URLs that have it."""
    held = staged(urls.select("row", "url").mapInArrow(_keys, "row long, key long, m long"), "url-keys")
    kinds = F.explode(F.array(*[
        F.struct(F.lit(side * (ORDER + 1) + k).alias("kind"), F.col("key").bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1)).bitwiseOR(F.lit((side << 51) | (k << 48))).alias("pair"))
        for side in (0, 1) for k in range(ORDER + 1)
    ])).alias("x")
    asked = held.select("key").distinct().select("key", kinds).select("key", "x.kind", "x.pair", F.shiftright("x.pair", 8).alias("context"))
    found = asked.join(model.pairs, "pair", "left").join(model.contexts, "context", "left").select("key", "kind", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("c", "n", "t")])
    rows = found.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("kind", "c", "n", "t"))).alias("x"))  # ten a key
    gains = rows.select("key", *[F.col(f"x.{x}").alias(x) for x in ("c", "n", "t")]).mapInArrow(_gains, "key long, gain double")
    return held.join(sent_or_shuffled(gains, "url-gains", PAIRS), "key").groupBy("row").agg((F.sum(F.col("gain") * F.col("m")) / F.sum("m")).alias("ratio"))


def with_ratios(rows: DataFrame, model: UrlModel | StoredModel) -> DataFrame:
    """``rows`` (url and others) with ``ratio`` in place of the url."""
    keep = [c for c in rows.columns if c != "url"]
    if isinstance(model, UrlModel):
        kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep)
        return rows.select("url", *keep).mapInArrow(_ratios(rows.sparkSession.sparkContext.broadcast(model), keep), f"{kinds}, ratio double")
    numbered = staged(rows.withColumn("row", F.monotonically_increasing_id()), "url-rows")
    return numbered.drop("url").join(joined_ratios(numbered, model), "row").select(*keep, "ratio")


def train(ruled: DataFrame) -> UrlModel | StoredModel:
    """Count all labelled URLs but a fifth, which then sets the threshold: the point that errs least on either class.

    Without labelled URLs of both classes the threshold accepts all.
    """
    spark = ruled.sparkSession
    labelled = ruled.where("decided IS NOT NULL AND url IS NOT NULL").select(
        F.col("url").cast("binary").alias("url"), (F.col("decided") == "block").cast("int").alias("side"),
        (F.crc32(F.col("url").cast("binary")) % FOLDS == 0).alias("kept_back"),
    )
    pairs = staged(labelled.where("NOT kept_back").select("url", "side").mapInArrow(_count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "url-pairs")
    context = F.shiftright("pair", 8).alias("context")
    contexts = staged(pairs.groupBy(context).agg(F.sum("n").alias("n"), F.count("*").alias("t")), "url-contexts")
    model = StoredModel(pairs.select("pair", F.col("n").alias("c")), contexts)
    if pairs.count() <= PAIRS:  # few enough to be sent to where the URLs are
        kept, own = model.pairs.toArrow(), contexts.toArrow()
        numbers = lambda t, c: t.column(c).to_numpy()
        model = UrlModel(Counts(numbers(kept, "pair"), numbers(kept, "c")), Counts(numbers(own, "context"), numbers(own, "n")), Counts(numbers(own, "context"), numbers(own, "t")))
    scored = with_ratios(labelled.where("kept_back").select("url", "side"), model)
    spread = BINS / (2 * SPREAD)
    bins = np.zeros((2, BINS))
    for r in scored.groupBy("side", F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor((F.col("ratio") + SPREAD) * spread))).alias("bin")).agg(F.count("*").alias("n")).collect():
        bins[r.side, r.bin] = r.n
    if not bins.sum(axis=1).all():
        model.threshold = -np.inf
        return model
    share = np.concatenate((np.zeros((2, 1)), np.cumsum(bins, axis=1)), axis=1) / bins.sum(axis=1)[:, None]
    wrong = share[0] + 1 - share[1]  # accepted below the threshold, rejected above it
    best = np.flatnonzero(wrong <= wrong.min() + 1e-12)
    model.threshold = float(best[len(best) // 2] / spread - SPREAD)
    return model


def _ratios(model, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = model.value.ratio(b.column(0).to_pylist()) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in keep), pa.array(found, pa.float64())], names=[*keep, "ratio"])

    return run


def judge(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict, ratio.

    A null url, or one without ``://``, has an empty host and path, so no rule; the model
    judges it like any other (null as an empty url). Null ids and repeated rows each give a row;
    other columns are ignored; an empty table gives an empty result.
    """
    small_batches(pages.sparkSession)
    ruled = with_rules(pages, rules, id_col, url_col)
    model = train(ruled)
    scored = with_ratios(ruled.select(F.col("url").cast("binary").alias("url"), "page_id", "host", "path", "rule", "decided"), model)
    by_model = F.when(F.col("ratio") >= F.lit(model.threshold), "allow").otherwise("block")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("decided", by_model).alias("verdict"), "ratio")
