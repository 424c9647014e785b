"""Vocabularies: counts, frequency ranks, deciles, samples, extension, held-out splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postwright.functions.hashing import sample_key
from postwright.operators.ordering import top_k
from postwright.sources.staging import staged

#: Words flagged and never held out (fixed values).
STOP_WORDS = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with"]


def term_counts(toks: DataFrame) -> DataFrame:
    """(word, freq): occurrences (A1). Counted on the map side first."""
    return toks.groupBy("word").agg(F.count("*").alias("freq"))


def document_counts(toks: DataFrame) -> DataFrame:
    """(word, df, tf): passages and occurrences (A2). Counting within passages first makes the distinct count a plain one."""
    return toks.groupBy("word", "pid").agg(F.count("*").alias("n")).groupBy("word").agg(F.count("*").alias("df"), F.sum("n").alias("tf"))


def new_words(counts: DataFrame, known: DataFrame) -> DataFrame:
    """Counts of words outside a vocabulary."""
    return counts.join(known.select("word"), "word", "left_anti")


def frequency_decile(rank: Column, n: Column) -> Column:
    """floor(10 rank / n), 9 at most; rank from 0. Not ntile: groups differ where n is no multiple of ten."""
    return F.least(F.floor(rank * 10 / n), F.lit(9)).cast("int")


def vocabulary(counts: DataFrame, floor: int = 100, most: int = 30_000, stop_words: list[str] = STOP_WORDS) -> DataFrame:
    """(entry_id, word, freq, decile, is_stop): the most frequent words over a floor, by (-freq, word).

    At most ``most`` words reach the window that numbers them, whatever the corpus.
    """
    top = counts.where(F.col("freq") >= floor).orderBy(F.desc("freq"), "word").limit(most)
    everything = Window.partitionBy(F.lit(0))
    ranked = top.select("word", "freq", (F.row_number().over(everything.orderBy(F.desc("freq"), "word")) - 1).alias("entry_id"), F.count("*").over(everything).alias("n"))
    return ranked.select(
        F.col("entry_id").cast("int").alias("entry_id"), "word", "freq", frequency_decile(F.col("entry_id"), F.col("n")).alias("decile"), F.col("word").isin(stop_words).alias("is_stop")
    )


#: Keys that limits are sent to all executors for; more are joined.
SENT_KEYS = 262_144


def occurrence_sample(pairs: DataFrame, key: str = "entry_id", most: int = 100, seed: str = "occ") -> DataFrame:
    """(key, pid, slot): up to ``most`` passages of each entry, those with the smallest hash; the same whatever the partitioning."""
    drawn = pairs.select(key, "pid").distinct().withColumn("h", sample_key(seed, key, "pid"))
    return top_k(drawn, [key], [F.col("h"), F.col("pid")], most, "slot").select(key, "pid", (F.col("slot") - 1).alias("slot"))


def sample_limits(pairs: DataFrame, key: str, most: int) -> DataFrame:
    """(key, limit): a bound on the hash under which about ``most`` passages of each entry lie, and some more; over all hashes for entries of few. ``pairs``: each pair once, or almost."""
    n = pairs.groupBy(key).agg(F.count("*").alias("n"))
    few = most + 10 * int(most**0.5) + 50
    return n.select(key, "n", F.when(F.col("n") <= few, "g").otherwise(F.lower(F.lpad(F.hex((F.lit(float(few << 32)) / F.col("n")).cast("long")), 8, "0"))).alias("limit"))


def under_limits(rows: DataFrame, limits: DataFrame, key: str, seed: str = "occ") -> DataFrame:
    """``rows`` (key, pid and more) whose hash lies under their entry's limit: what a sample is drawn from, found where the rows are."""
    sent = F.broadcast(limits) if limits.count() <= SENT_KEYS else limits
    return rows.join(sent.select(key, "limit"), key).where(sample_key(seed, key, "pid") < F.col("limit")).drop("limit")


def bounded_sample(pairs: DataFrame, rows: DataFrame, key: str = "entry_id", most: int = 100, seed: str = "occ") -> tuple[DataFrame, DataFrame]:
    """(slots as from ``occurrence_sample(rows, key, most, seed)``, the rows that they are drawn from), whatever the number of rows: only those that can be drawn are moved and sorted.

    ``pairs``: the distinct pairs of ``rows``, which are counted. An entry of which fewer than ``most`` passages lie under its limit, though it has more, is drawn from all its rows; so the
    sample is the same as without limits.
    """
    limits = staged(sample_limits(pairs, key, most), "limits")
    near = completed(staged(under_limits(rows, limits, key, seed), "drawn-from"), rows, limits, key, most)
    return occurrence_sample(near, key, most, seed), near


def completed(near: DataFrame, rows: DataFrame, limits: DataFrame, key: str, most: int) -> DataFrame:
    """``near``, the rows under the limits, with all rows of the entries of which fewer than ``most`` passages lie under theirs."""
    found = near.select(key, "pid").distinct().groupBy(key).agg(F.count("*").alias("found"))
    short = staged(limits.where("limit < 'g'").join(found, key, "left").where(F.coalesce("found", F.lit(0)) < most).select(key), "short")
    if not short.isEmpty():
        near = staged(near.join(short, key, "left_anti").unionByName(rows.join(short, key, "left_semi").select(*near.columns)), "drawn-from")
    return near


def decile_profile(vocab: DataFrame) -> DataFrame:
    """Frequencies by decile: least, tenth percentile, median, ninetieth, largest."""
    return vocab.groupBy("decile").agg(
        F.min("freq").alias("least"), F.percentile("freq", F.lit(0.1)).alias("p10"), F.median("freq").alias("median"), F.percentile("freq", F.lit(0.9)).alias("p90"), F.max("freq").alias("most")
    )


def decile_edges(vocab: DataFrame) -> DataFrame:
    """(decile, edge): the smallest frequency of each decile."""
    return vocab.groupBy("decile").agg(F.min("freq").alias("edge"))


def mapped_decile(rates: DataFrame, edges: DataFrame, rate: str = "rate") -> DataFrame:
    """``rates`` with the first decile whose edge its rate reaches, else 9 (J12). Ten edges at most ride along as an array, so nothing is joined by range."""
    all_edges = edges.agg(F.array_sort(F.collect_list(F.struct("decile", "edge"))).alias("edges"))
    reached = F.filter("edges", lambda e: F.col(rate) >= e["edge"])
    return rates.join(F.broadcast(all_edges)).withColumn("decile", F.coalesce(F.get(reached, 0)["decile"], F.lit(9))).drop("edges")


def per_million(count: Column, total: Column) -> Column:
    return count * 1e6 / total


def extend(vocab: DataFrame, added: DataFrame) -> DataFrame:
    """The vocabulary and then new words, numbered on from its end in the order of their ranks (O7). ``added``: word, freq, decile, rank from 0.

    Words that the vocabulary has already are refused by leaving them out.
    """
    fresh = added.join(vocab.select("word"), "word", "left_anti")
    n = vocab.agg(F.count("*").cast("int").alias("n_base"))
    w = Window.partitionBy(F.lit(0)).orderBy("rank", "word")  # the words to add are few by selection
    new = fresh.join(F.broadcast(n)).select(
        (F.col("n_base") + F.row_number().over(w) - 1).cast("int").alias("entry_id"), "word", "freq", F.col("decile").cast("int").alias("decile"), F.lit(False).alias("is_stop"), F.lit(True).alias("inserted")
    )
    return vocab.select("entry_id", "word", "freq", "decile", "is_stop").withColumn("inserted", F.lit(False)).unionByName(new)


def splits(pids: DataFrame, relevant: DataFrame, n_q: int, n_s: int, seed: str = "splits") -> DataFrame:
    """(pid, name): Q and S drawn without replacement in hash order, P all others that no query is judged on."""
    drawn = pids.select("pid", sample_key(seed, "pid").alias("h")).orderBy("h", "pid").limit(n_q + n_s)
    ranked = drawn.withColumn("r", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("h", "pid")))  # a sample, bounded by its size
    q = ranked.where(F.col("r") <= n_q).select("pid", F.lit("Q").alias("name"))
    s = ranked.where(F.col("r") > n_q).select("pid", F.lit("S").alias("name"))
    p = pids.select("pid").join(q, "pid", "left_anti").join(relevant.select("pid"), "pid", "left_anti").select("pid", F.lit("P").alias("name"))
    return q.union(s).union(p)


def uniform_sample(rows: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """``n`` rows in hash order of their key."""
    return rows.withColumn("h", sample_key(seed, key)).orderBy("h", key).limit(n).drop("h")


def stratified_sample(vocab: DataFrame, share: float, seed: str, stratum: str = "decile", key: str = "word") -> DataFrame:
    """A share of each stratum, rounded half to even, in hash order; stop words are never drawn."""
    w = Window.partitionBy(stratum)
    ranked = vocab.where("NOT is_stop").withColumns({
        "n": F.count("*").over(w), "r": F.row_number().over(w.orderBy(sample_key(seed, key), key))
    })
    return ranked.where(F.col("r") <= F.bround(F.col("n") * share)).drop("n", "r")


def held_out(vocab: DataFrame, seed: str = "split/random", share: float = 0.2) -> DataFrame:
    """(split, entry_id, held) for the random split and the rarest-decile split, over all entries."""
    drawn = stratified_sample(vocab, share, seed).select("entry_id", F.lit(True).alias("h"))
    random = vocab.join(drawn, "entry_id", "left").select(F.lit("random").alias("split"), "entry_id", F.coalesce("h", F.lit(False)).alias("held"))
    rare = vocab.select(F.lit("rare").alias("split"), "entry_id", ((F.col("decile") == 9) & ~F.col("is_stop")).alias("held"))
    return random.union(rare)


def held_clusters(clusters: DataFrame, n_vocab: int, low: float = 0.15, high: float = 0.25, seed: str = "split/cluster", at_most: int = 10_000) -> DataFrame:
    """Clusters held out together: in hash order, one that would exceed ``high`` is skipped, and none follows once ``low`` is reached.

    ``clusters``: cluster, size; at most ``at_most`` of them fold in one row, checked.
    """
    if clusters.limit(at_most + 1).count() > at_most:
        raise ValueError(f"more than {at_most} clusters")
    ordered = clusters.agg(F.array_sort(F.collect_list(F.struct(sample_key(seed, "cluster").alias("h"), "cluster", "size"))).alias("all"))
    kind = clusters.schema["cluster"].dataType.simpleString()
    start = F.struct(F.lit(0).cast("long").alias("n"), F.array().cast(f"array<{kind}>").alias("kept"))

    def step(acc, c):
        takes = (acc["n"] < low * n_vocab) & (acc["n"] + c["size"] <= high * n_vocab)
        return F.struct((acc["n"] + F.when(takes, c["size"]).otherwise(0)).cast("long").alias("n"), F.when(takes, F.array_append(acc["kept"], c["cluster"])).otherwise(acc["kept"]).alias("kept"))

    return ordered.select(F.explode(F.aggregate("all", start, step)["kept"]).alias("cluster"))
