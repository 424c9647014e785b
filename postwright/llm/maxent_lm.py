"""Language-model scores by a hashed maximum-entropy model.

P(word | history) = P(class | history) * P(word | class, word before). The frequent words make
classes of like total frequency and all other words one more class. The class factor is a softmax over hashed
features of the history: the word before, the word two before (a skip), the two together,
and the first with the third (a skip pair). It is trained by distributed gradient updates: in each round every
partition takes Adagrad steps over its own documents, and the weights are averaged by how often each was
updated. The word factor is a softmax with a weight for each word and each bucket of the word before;
its gradient needs nothing but counts, which the same passes gather from all training documents, and each bucket's weights
are fitted by a task of their own. Words outside the
model's list share their class by smoothed counts, in which unseen words have their part, so
the probabilities of all texts are positive and sum to one.

Texts are split and looked up once and written as numbers; training and scoring read those. The words with weights
of their own and the hashed feature rows grow with the cube root of the training tokens. Word counts are exact and cover
the corpus; the most frequent are sent to executors, counts of other words reach their documents by a join.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postwright.llm._common import id_crc, only, small_batches, staged

#: The end of a text, a token no word can be: words hold no white space.
END = b"\n"
#: Frequent words whose counts are sent to executors, at most, and their longest length in bytes: 16 MB.
LISTED = 1 << 18
LONGEST = 64
#: Words that have weights of their own and hashed feature rows, up to so many training tokens; from there on both grow with the cube root of the tokens.
MODEL_WORDS = 4096
ROWS = 1 << 15
GROWS_FROM = 1 << 24
#: Classes of words, buckets of the word before.
CLASSES = 32
BUCKETS = 256
HISTORY = 3
ROUNDS = 2
#: Feature rows in a block of weights; blocks are what partitions send to be averaged.
BLOCK = 32
#: Words a task counts before it hands the counts on.
COUNTED = 250_000
BATCH = 8192
RATE = 0.3


def words_of(text: bytes | None) -> list[bytes]:
    """Words after lower-casing A-Z, split at ASCII white space."""
    return (text or b"").lower().split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[bytes] = Counter()

    def out():
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    for b in batches:
        for text in b.column(0).to_pylist():
            words = words_of(text)
            for at in range(0, len(words), COUNTED):
                counts.update(words[at : at + COUNTED])
                if len(counts) > COUNTED:
                    yield out()
                    counts.clear()
            counts[END] += 1
    yield out()


def word_counts(texts: DataFrame) -> DataFrame:
    """(word binary, n long) over a column ``text`` (binary), the end of each text counted as a word."""
    return texts.mapInArrow(_count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """Frequent words in order of frequency, with counts; totals over all training tokens."""

    words: list[bytes]
    counts: np.ndarray
    tokens: int
    types: int
    classes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    rows: int = 0

    def __post_init__(self):
        more = max(1.0, self.tokens / GROWS_FROM) ** (1 / 3)
        self.rows = int(ROWS * more) // BLOCK * BLOCK
        n = min(int(MODEL_WORDS * more), len(self.words))
        mass = np.sqrt(self.counts[:n].astype(float))
        share = (np.cumsum(mass) - mass / 2) / max(mass.sum(), 1e-9)
        spread = np.minimum((share * (CLASSES - 1)).astype(np.int64), CLASSES - 2)
        self.classes = np.unique(spread, return_inverse=True)[1].astype(np.int64)  # a very frequent word may span several: number on without gaps
        self.rest_tokens = self.tokens - int(self.counts[:n].sum())
        self.rest_types = self.types - n

    @property
    def n_model(self) -> int:
        return len(self.classes)


class Reader:
    """Texts as numbers: a listed word's rank, else ``len(words)``."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.rank = {w: k for k, w in enumerate(vocab.words)}
        self.none = len(vocab.words)
        self.end = self.rank.get(END, self.none)

    def ids(self, words: list[bytes]) -> np.ndarray:
        get, none = self.rank.get, self.none
        out = np.empty(len(words) + 1, "<u4")
        out[:-1] = [get(w, none) for w in words]
        out[-1] = self.end
        return out

    def batch(self, pieces: list[tuple[int, np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(document, id, feature rows, bucket of the word before) of each token of some pieces (see ``pieces_of``); histories end at the starts of documents."""
        ids = np.concatenate([p for _, p, _ in pieces]).astype(np.int64)
        sizes = np.array([len(p) for _, p, _ in pieces])
        place = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        before = []
        for k in range(1, HISTORY + 1):
            h = np.full(len(ids), self.none + 1)
            h[k:] = ids[:-k]
            h[place < k] = self.none + 1
            before.append(h.astype(np.uint64))
        one, two, three = before
        n = self.vocab.rows
        rows = np.stack([hashed(one, 1, n), hashed(two, 2, n), hashed(one * np.uint64(1 << 20) + two, 3, n), hashed(one * np.uint64(1 << 20) + three, 4, n)], axis=1)
        half = BUCKETS // 2
        bucket = np.where(one < half, one.astype(np.int64), half + hashed(one, 5, half))
        own = np.repeat(np.array([k for k, _, _ in pieces]), sizes)
        if any(skip for _, _, skip in pieces):  # tokens that stand here just as history
            new = place >= np.repeat(np.array([skip for _, _, skip in pieces]), sizes)
            return own[new], ids[new], rows[new], bucket[new]
        return own, ids, rows, bucket


def pieces_of(docs: list[np.ndarray], most: int = 4 * BATCH) -> Iterator[list[tuple[int, np.ndarray, int]]]:
    """Documents' ids in lists of about ``most``: (document, ids, how many of them are just history). A longer document comes in several."""
    held, size = [], 0
    for k, ids in enumerate(docs):
        for at in range(0, len(ids), most):
            skip = min(HISTORY, at)
            held.append((k, ids[at - skip : at + most], skip))
            size += len(held[-1][1])
            if size >= most:
                yield held
                held, size = [], 0
    if held:
        yield held


def hashed(x: np.ndarray, seed: int, n: int) -> np.ndarray:
    """A number below ``n`` (at most 2**32) for each of x."""
    h = (x + np.uint64(seed * 0x632BE59BD9B4E019 % (1 << 64))) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    return (((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def class_logits(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray) -> np.ndarray:
    z = weights.take(rows[:, 0], axis=0)
    for k in range(1, rows.shape[1]):
        z += weights.take(rows[:, k], axis=0)
    z += bias
    return z


def order_of(rows: np.ndarray) -> np.ndarray:
    """A stable order of numbers below 2**32, by halves of 16 bits, which numpy sorts by counting."""
    order = np.argsort((rows & 0xFFFF).astype(np.uint16), kind="stable")
    high = rows >> 16
    return order[np.argsort(high[order].astype(np.uint16), kind="stable")] if high.any() else order


def sums_of_runs(values: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The sum of the ``n`` rows of ``values`` from each ``first`` on. Most runs are short: all take their next row at once, the few long ones that remain end alone."""
    out = values.take(first, axis=0)
    left, level = np.flatnonzero(n > 1), 1
    while len(left) > 64:
        out[left] += values.take(first[left] + level, axis=0)
        level += 1
        left = left[n[left] > level]
    for k in left.tolist():
        out[k] += values[first[k] + level : first[k] + n[k]].sum(axis=0)
    return out


def classes_of(ids: np.ndarray, vocab: Vocabulary) -> np.ndarray:
    if not vocab.n_model:
        return np.full(len(ids), CLASSES - 1)
    return np.where(ids < vocab.n_model, vocab.classes[np.minimum(ids, vocab.n_model - 1)], CLASSES - 1)


def step(weights: np.ndarray, bias: np.ndarray, power: np.ndarray, used: np.ndarray, rows: np.ndarray, classes: np.ndarray) -> None:
    """One Adagrad step on a batch of tokens, in place. ``power``: each row's squared gradients; ``used``: tokens that updated it."""
    p = class_logits(weights, bias, rows)
    p -= p.max(axis=1, keepdims=True)
    np.exp(p, out=p)
    p /= p.sum(axis=1, keepdims=True)
    p[np.arange(len(p)), classes] -= 1
    bias -= (0.1 * p.mean(axis=0)).astype(np.float32)
    flat = rows.ravel()
    order = order_of(flat)
    ordered = flat[order]
    first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    touched, n = ordered[first], np.diff(np.append(first, len(ordered)))
    grad = sums_of_runs(p.take(order // rows.shape[1], axis=0), first, n)
    grad /= np.sqrt(n, dtype=np.float32)[:, None]
    power[touched] += np.einsum("ij,ij->i", grad, grad) / grad.shape[1]
    grad *= (RATE / np.sqrt(power[touched] + 1e-3)).astype(np.float32)[:, None]
    weights[touched] -= grad
    used[touched] += n


@dataclass
class Model:
    vocab: Vocabulary
    weights: np.ndarray
    bias: np.ndarray
    by_bucket: np.ndarray  # for each bucket and word the log-probability in the word's class

    def log10(self, reader: Reader, docs: list[np.ndarray]) -> np.ndarray:
        """log10 probability of each document; of a word outside the list just its class (see ``rest_norm``)."""
        found = np.zeros(len(docs))
        for pieces in pieces_of(docs):
            own, ids, rows, bucket = reader.batch(pieces)
            for at in range(0, len(ids), BATCH):
                part = slice(at, at + BATCH)
                c = classes_of(ids[part], self.vocab)
                logp = log_softmax(class_logits(self.weights, self.bias, rows[part]))[np.arange(len(c)), c].astype(float)
                known = ids[part] < self.vocab.n_model
                if self.vocab.n_model:
                    logp += np.where(known, self.by_bucket[bucket[part], np.minimum(ids[part], self.vocab.n_model - 1)], 0.0)
                found += np.bincount(own[part], logp, minlength=len(docs))
        return found / np.log(10)


def rest_norm(vocab: Vocabulary) -> float:
    """What divides (count + 0.1) for a word outside the model's list; all unseen words together are one more type."""
    return vocab.rest_tokens + 0.1 * (vocab.rest_types + 1)


#: What training sends on: a kind (0 weights, 1 pair counts, 2 bias), a block of it, its numbers.
SUMS = "kind int, block int, data binary"


def _sums(kinds: list[int], blocks: list[int], data: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(blocks, pa.int32()), pa.array(data, pa.binary())], names=["kind", "block", "data"])


def _ids(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), "<u4") for x in column]


def _train(vocab_b, model_b):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(vocab_b.value)
        weights, bias = (x.copy() for x in model_b.value)
        start, n_rows = model_b.value[0], reader.vocab.rows
        power, used = np.zeros(n_rows, np.float32), np.zeros(n_rows, np.float32)
        n_model = reader.vocab.n_model
        pairs = np.zeros(BUCKETS * max(1, n_model), np.int64)
        n_tokens = 0
        for b in batches:
            for pieces in pieces_of(_ids(b.column(0))):
                _, ids, rows, bucket = reader.batch(pieces)
                classes = classes_of(ids, reader.vocab)
                for at in range(0, len(ids), BATCH):
                    step(weights, bias, power, used, rows[at : at + BATCH], classes[at : at + BATCH])
                known = ids < n_model
                at, n = np.unique(bucket[known] * n_model + ids[known], return_counts=True)
                pairs[at] += n
                n_tokens += len(ids)
        if not n_tokens:
            return
        # Changes weighted by use, as blocks; then pair counts; then the bias.
        for k in range(n_rows // BLOCK):
            rows = slice(k * BLOCK, (k + 1) * BLOCK)
            if used[rows].any():
                change = np.column_stack([(weights[rows] - start[rows]) * used[rows, None], used[rows]])
                yield _sums([0], [k], [change.astype("<f4").tobytes()])
        for k, counts in enumerate(pairs.reshape(BUCKETS, -1)):
            if counts.any():
                yield _sums([1], [k], [counts.astype("<i4").tobytes() if counts.max() < 1 << 31 else counts.astype("<i8").tobytes()])
        yield _sums([2], [0], [np.append((bias - model_b.value[1]) * n_tokens, n_tokens).astype("<f4").tobytes()])

    return run


def counts_from(data: bytes, n: int) -> np.ndarray:
    """``n`` whole numbers of four or eight bytes each."""
    return np.frombuffer(data, "<i4" if len(data) == 4 * n else "<i8").astype(np.int64)


def _add_up(n_model: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for kind, block, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                x = counts_from(data, max(1, n_model)) if kind == 1 else np.frombuffer(data, "<f4").astype(np.float64)
                sums[kind, block] = sums[kind, block] + x if (kind, block) in sums else x
        for (kind, block), x in sums.items():
            yield _sums([kind], [block], [x.astype("<i8" if kind == 1 else "<f4").tobytes()])

    return run


def _fit_words(vocab_b):
    """Pair counts of buckets to the log-probabilities of words in them: each bucket has weights of its own, so tasks fit buckets side by side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, sums = vocab_b.value, {}
        for b in batches:
            for block, data in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                sums[block] = sums.get(block, 0) + counts_from(data, vocab.n_model)
        for block, counts in sums.items():
            yield _sums([1], [block], [word_factor(counts[None], vocab.counts[: vocab.n_model], vocab.classes).astype("<f4").tobytes()])

    return run


def word_factor(pairs: np.ndarray, counts: np.ndarray, classes: np.ndarray, steps: int = 40, ridge: float = 0.05, rate: float = 0.5) -> np.ndarray:
    """log P(word | class, bucket): Adagrad steps on the exact counts of (bucket, word), from the words' frequencies on."""
    # Words of a class lie together: ranks are sorted by class.
    first = np.flatnonzero(np.concatenate(([True], classes[1:] != classes[:-1])))
    which = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(classes))))
    total = np.add.reduceat(pairs, first, axis=1)
    bias, extra, power = np.log(counts + 0.1), np.zeros(pairs.shape), np.full(pairs.shape, 1e-6)

    def log_p():
        z = bias + extra
        z -= np.maximum.reduceat(z, first, axis=1)[:, which]
        return z - np.log(np.add.reduceat(np.exp(z), first, axis=1))[:, which]

    for _ in range(steps):
        grad = pairs - total[:, which] * np.exp(log_p()) - ridge * extra
        power += grad * grad
        extra += rate * grad / np.sqrt(power)
    return log_p().astype(np.float32)


def frequent(counts: DataFrame, most: int) -> DataFrame:
    """The most frequent words, ``most`` at most, of all that are short enough to be sent along.

    Frequencies fall into steps of a hundredth (4,096 at most, whole numbers at the low end); the words over
    the lowest step that still fits are taken where they are, so no task sorts the vocabulary.
    """
    short = counts.where(F.length("word") <= LONGEST).withColumn("step", F.floor(F.log2(F.col("n").cast("double")) * 64))
    total, lowest = 0, None
    for r in sorted(short.groupBy("step").agg(F.count("*").alias("k")).collect(), key=lambda r: -r.step):
        total += r.k
        if total > most:
            break
        lowest = r.step
    return short.where(F.col("step") >= lowest if lowest is not None else F.lit(False)).select("word", "n")


def vocabulary(counts: DataFrame) -> Vocabulary:
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    top = frequent(counts, LISTED).toArrow().sort_by([("n", "descending"), ("word", "ascending")])
    return Vocabulary([bytes(w) for w in top.column("word").to_pylist()], top.column("n").to_numpy(), int(total[0]), int(total[1]))


def fit(texts: DataFrame, vocab: Vocabulary, vocab_b=None) -> Model:
    """``texts``: training texts with columns shard (0 to ROUNDS - 1) and ids (as ``Reader.ids`` in four bytes each)."""
    context = texts.sparkSession.sparkContext
    vocab_b = vocab_b or context.broadcast(vocab)
    weights, bias = np.zeros((vocab.rows, CLASSES), np.float32), np.zeros(CLASSES, np.float32)
    per_class = np.bincount(vocab.classes, vocab.counts[: vocab.n_model], minlength=CLASSES) if vocab.n_model else np.zeros(CLASSES)
    per_class[CLASSES - 1] += rest_norm(vocab)
    bias[:] = np.where(per_class > 0, np.log((per_class + 1) / (per_class + 1).sum()), -1e4)  # classes without words get no probability, ever
    # A task sends a whole model on, so it should read more than that: the fewer tasks of a small corpus also learn more each.
    model_bytes = weights.nbytes + 4 * BUCKETS * vocab.n_model
    tasks = max(2 * context.defaultParallelism, 4 * vocab.tokens // (ROUNDS * model_bytes))
    seen = []
    for shard in range(ROUNDS):
        model_b = context.broadcast((weights, bias))
        own = texts.where(F.col("shard") == shard).select("ids").coalesce(tasks)
        parts = own.mapInArrow(_train(vocab_b, model_b), SUMS).repartition("kind", "block").mapInArrow(_add_up(vocab.n_model), SUMS)
        parts = staged(parts, "lm-sums")
        seen.append(parts.where("kind = 1"))
        for r in parts.where("kind <> 1").toLocalIterator():
            x = np.frombuffer(r.data, "<f4")
            if r.kind == 0:
                x = x.reshape(BLOCK, CLASSES + 1)
                weights[r.block * BLOCK : (r.block + 1) * BLOCK] += x[:, :-1] / np.maximum(x[:, -1:], 1)
            else:
                bias += x[:-1] / max(float(x[-1]), 1.0)
    by_bucket = np.zeros((BUCKETS, max(1, vocab.n_model)), np.float32)
    if vocab.n_model:
        by_bucket[:] = word_factor(np.zeros((1, vocab.n_model)), vocab.counts[: vocab.n_model], vocab.classes)
        pairs = seen[0]
        for more in seen[1:]:
            pairs = pairs.union(more)
        for r in pairs.repartition("block").mapInArrow(_fit_words(vocab_b), SUMS).toLocalIterator():
            by_bucket[r.block] = np.frombuffer(r.data, "<f4")
    return Model(vocab, weights, bias, by_bucket)


MISSING = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())]))


def _encode(vocab_b):
    """(doc_id, row, held_out, shard, text) to ids and what the base score needs of listed words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocab_b.value
        reader = Reader(vocab)
        logs = np.append(np.log10(vocab.counts + 0.1), 0.0)
        for b in batches:
            raw, n_tokens, known, base, rest, rest_base, missing = [], [], [], [], [], [], []
            for text in b.column(4).to_pylist():
                words = words_of(text)
                ids = reader.ids(words)
                listed = ids < reader.none
                logp = logs[ids]
                raw.append(ids.tobytes())
                n_tokens.append(len(ids))
                known.append(int(listed.sum()))
                base.append(float(logp.sum()))
                beyond = ids >= vocab.n_model
                rest.append(int(beyond.sum()))
                rest_base.append(float(logp[beyond].sum()))  # words that are not listed add nothing
                lost = Counter(words[k] for k in np.flatnonzero(~listed[:-1]).tolist())
                if not listed[-1]:
                    lost[END] += 1
                missing.append([{"word": w, "n": n} for w, n in lost.items()])
            numbers = [pa.array(x, pa.int64()) for x in (n_tokens, known)], [pa.array(base, pa.float64()), pa.array(rest, pa.int64()), pa.array(rest_base, pa.float64())]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:4], pa.array(raw, pa.binary()), *numbers[0], *numbers[1], pa.array(missing, MISSING)],
                names=["doc_id", "row", "held_out", "shard", "ids", "n_tokens", "listed", "listed_base", "n_rest", "rest_base", "missing"],
            )

    return run


def _score(model_b):
    """All columns but the first, which holds the ids, and the model's score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_b.value
        reader = Reader(model.vocab)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(model.log10(reader, _ids(b.column(0))), pa.float64())], names=[*b.schema.names[1:], "model"])

    return run


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: log10 probabilities of whole texts.

    Held out are rows whose crc32 of the id mod ``folds`` is 0 (null ids among them); all others train.
    Null text is empty: the end token alone. Repeated rows each train and are scored; other columns are ignored;
    an empty table gives an empty result. If nothing trains, every word is unseen.
    """
    spark = docs.sparkSession
    small_batches(spark)
    d = only(docs, doc_id=id_col, text=text_col).select("doc_id", F.col("text").cast("binary").alias("text"), id_crc(F.col("doc_id")).alias("crc"))
    counts = staged(word_counts(d.where(F.col("crc") % folds != 0).select("text")), "word-counts")
    vocab = vocabulary(counts)
    vocab_b = spark.sparkContext.broadcast(vocab)
    kind = d.schema["doc_id"].dataType.simpleString()
    shard = F.when(F.col("crc") % folds != 0, (F.floor(F.col("crc") / folds) % ROUNDS).cast("int")).otherwise(-1)
    schema = (f"doc_id {kind}, row long, held_out boolean, shard int, ids binary, n_tokens long, listed long, listed_base double, n_rest long, rest_base double, "
              "missing array<struct<word:binary,n:bigint>>")
    encoded = staged(
        d.select("doc_id", F.monotonically_increasing_id().alias("row"), (F.col("crc") % folds == 0).alias("held_out"), shard.alias("shard"), "text").mapInArrow(_encode(vocab_b), schema),
        "lm-ids",
    )
    model = fit(encoded, vocab, vocab_b)
    numbers = ["row", "doc_id", "held_out", "n_tokens", "listed", "listed_base", "n_rest", "rest_base"]
    kinds = ", ".join(f"{n} {encoded.schema[n].dataType.simpleString()}" for n in numbers)
    part = encoded.select("ids", *numbers).mapInArrow(_score(spark.sparkContext.broadcast(model)), f"{kinds}, model double")
    # Words that were not sent along: their counts come by a join, one row for each word of a document.
    lost = encoded.select("row", F.explode("missing").alias("m")).select("row", F.col("m.word").alias("word"), F.col("m.n").alias("k"))
    tail = (
        lost.join(counts, "word", "left")
        .groupBy("row").agg(F.sum(F.col("k") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(0.1))).alias("tail"), F.sum(F.when(F.col("n").isNotNull(), F.col("k")).otherwise(0)).alias("tail_known"))
    )
    n, v = vocab.tokens, vocab.types
    base_norm, norm = float(np.log10(n + 0.1 * (v + 1))), float(np.log10(rest_norm(vocab)))
    extra = F.coalesce("tail", F.lit(0.0))
    return part.join(tail, "row", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("listed") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("listed_base") + extra - F.col("n_tokens") * F.lit(base_norm)).alias("base_score"),
        (F.col("model") + F.col("rest_base") + extra - F.col("n_rest") * F.lit(norm)).alias("score"),
    )
