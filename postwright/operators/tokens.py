"""Tokens, bigrams and word units of passages."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postwright.functions import text as T


def tokens(passages: DataFrame, unicode: bool = False, most: int | None = None) -> DataFrame:
    """(pid, pos, word): lower-cased word runs in order (P1, P16), of the first ``most`` at most (P21). One map, no shuffle."""
    found = T.runs(F.col("text"), unicode)
    if most is not None:
        found = T.truncated(found, most)
    return passages.select("pid", F.posexplode(found).alias("pos", "word")).select("pid", "pos", F.lower("word").alias("word"))


def truncated_words(passages: DataFrame, most: int) -> DataFrame:
    """(pid, words): the first ``most`` lower-cased word runs of each passage as a list."""
    return passages.select("pid", F.transform(T.truncated(T.runs(F.col("text")), most), F.lower).alias("words"))


def alphabetic(toks: DataFrame) -> DataFrame:
    return toks.where(T.is_alphabetic(F.col("word")))


def once_per_passage(toks: DataFrame) -> DataFrame:
    """(pid, word), each pair once (P3). Distinct within the row before rows are made: see ``distinct_words``."""
    return toks.select("pid", "word").distinct()


def distinct_words(passages: DataFrame, unicode: bool = False) -> DataFrame:
    """(pid, word) once each, without a shuffle: duplicates go inside the array."""
    words = F.array_distinct(F.transform(T.runs(F.col("text"), unicode), F.lower))
    return passages.select("pid", F.explode(words).alias("word"))


def keep_known(toks: DataFrame, vocab: DataFrame) -> DataFrame:
    """Tokens that the vocabulary has (P4). The vocabulary is bounded, so the planner may broadcast it."""
    return toks.join(vocab.select("word"), "word", "left_semi")


def first_occurrence(toks: DataFrame) -> DataFrame:
    """(pid, word, pos) of each word's earliest place in a passage."""
    return toks.groupBy("pid", "word").agg(F.min("pos").alias("pos"))


def title_case_bigrams(passages: DataFrame, stop_words: list[str]) -> DataFrame:
    """(pid, phrase): neighbouring tokens that are both capitalised and no stop words, lower-cased (P12, W14). Adjacency is over all tokens."""
    t = T.runs(F.col("text"))
    ok = lambda w: w.rlike("^[A-Z][a-z]+$") & ~F.lower(w).isin(stop_words)
    pairs = F.zip_with(t, F.slice(t, 2, 1_000_000_000), lambda a, b: F.when(ok(a) & ok(b), F.lower(F.concat(a, F.lit(" "), b))))
    return passages.select("pid", F.explode(F.filter(pairs, lambda p: p.isNotNull())).alias("phrase"))


def adjacent(toks: DataFrame) -> DataFrame:
    """Tokens with the next word of the same passage, null at its end."""
    return toks.withColumn("next", F.lead("word").over(Window.partitionBy("pid").orderBy("pos")))


def successions(passages: DataFrame) -> DataFrame:
    """(pid, pos, word, next): tokens that have a next word in their passage, made inside the row: no shuffle, no window."""
    words = passages.select("pid", F.transform(T.runs(F.col("text")), F.lower).alias("w"))  # no filter on it, which would cut each text into words twice
    pairs = F.zip_with(F.slice(F.col("w"), F.lit(1), F.size("w") - 1), F.slice(F.col("w"), F.lit(2), F.size("w") - 1), lambda a, b: F.struct(a.alias("word"), b.alias("next")))
    return words.select("pid", F.posexplode(F.when(F.size("w") > 1, pairs)).alias("pos", "s")).select("pid", "pos", "s.word", "s.next")


def followed_words(passages: DataFrame) -> DataFrame:
    """(pid, word): the distinct words of each passage that have a next word, made inside the row."""
    words = F.transform(T.runs(F.col("text")), F.lower)
    kept = F.when(F.size("w") > 1, F.array_distinct(F.slice(F.col("w"), F.lit(1), F.size("w") - 1)))
    return passages.select("pid", words.alias("w")).select("pid", F.explode(kept).alias("word"))


def islands(rows: DataFrame, partition: str, order: str, key: str) -> DataFrame:
    """Number the runs of equal ``key`` within ``partition`` from 0."""
    w = Window.partitionBy(partition).orderBy(order)
    new = F.coalesce((F.lag(key).over(w) != F.col(key)).cast("int"), F.lit(0))
    return rows.withColumn("new", new).withColumn("island", F.sum("new").over(w)).drop("new")


def run_summary(passages: DataFrame, key) -> DataFrame:
    """(pid, n_islands, longest): how many runs of neighbouring tokens share their ``key`` (a function of the word), and the longest one's tokens; counted inside the row."""
    start = F.struct(F.lit(None).cast("int").alias("last"), F.lit(0).cast("long").alias("run"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("longest"))

    def step(acc, k):
        same = acc["last"].eqNullSafe(k)
        run = F.when(same, acc["run"] + 1).otherwise(F.lit(1).cast("long"))
        return F.struct(k.alias("last"), run.alias("run"), (acc["n"] + F.when(same, 0).otherwise(1)).alias("n"), F.greatest(acc["longest"], run).alias("longest"))

    keys = passages.select("pid", F.transform(T.runs(F.col("text")), lambda x: key(F.lower(x))).alias("k"))
    found = F.filter(F.array(F.aggregate("k", start, step)), lambda s: s["n"] > 0)
    return keys.select("pid", F.explode(found).alias("s")).select("pid", F.col("s.n").alias("n_islands"), F.col("s.longest").alias("longest"))


def word_units(pieces: DataFrame) -> DataFrame:
    """(pid, island, start, stop, surface): runs of pieces of one word joined (P15). ``pieces``: pid, pos, word_id, piece, start, stop."""
    grouped = islands(pieces, "pid", "pos", "word_id")
    return grouped.groupBy("pid", "island").agg(
        F.min("start").alias("start"), F.max("stop").alias("stop"),
        F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("pos", "piece"))), lambda p: p["piece"])).alias("surface"),
    )


#: Places of a cell of the grid that intervals are dealt to.
CELL = 64


def overlapping(pieces: DataFrame, runs: DataFrame, cell: int = CELL) -> DataFrame:
    """Pieces with every run of the same passage that they overlap.

    Each interval goes to the cells of a grid that it touches, and a pair is reported in the first cell that both touch: work grows with the intervals and the
    pairs found, and a long passage is shared out by cells. Empty intervals overlap what they lie inside of; those with a null end overlap nothing.
    """
    first = F.expr(f"floor(start / {cell})")
    cells = F.explode(F.sequence(first, F.greatest(first, F.expr(f"floor((stop - 1) / {cell})")))).alias("cell")
    a = pieces.where("start <= stop").select("pid", "start", "stop", first.alias("first"), cells).alias("a")
    b = runs.where("start <= stop").select("pid", "start", "stop", "run", first.alias("first"), cells).alias("b")
    same = (F.col("a.pid") == F.col("b.pid")) & (F.col("a.cell") == F.col("b.cell")) & (F.col("a.cell") == F.greatest("a.first", "b.first"))
    return a.join(b, same & (F.col("a.start") < F.col("b.stop")) & (F.col("a.stop") > F.col("b.start"))).select(
        "a.pid", F.col("a.start").alias("piece_start"), F.col("a.stop").alias("piece_stop"), F.col("b.run").alias("run")
    )


def stride(rows: DataFrame, key: str, step: int) -> DataFrame:
    """Every ``step``-th row by its number."""
    return rows.where(F.col(key) % step == 0)


#: Bytes of phrases that one pass over the texts looks for.
PHRASE_BYTES = 8 << 20


def containing(texts: DataFrame, phrases: DataFrame, id_col: str, phrase_id: str, text_col: str = "text", phrase_col: str = "phrase", block_bytes: int = PHRASE_BYTES) -> DataFrame:
    """(id, phrase id) of every text that holds a phrase anywhere, letter for letter. Null or empty phrases are in no text.

    Phrases are the query set: they go to the executors in blocks of bounded size as one automaton each, so a text is read once a block whatever their number.
    """
    spark = texts.sparkSession
    t = texts.where(F.col(text_col).isNotNull()).select(id_col, F.col(text_col).alias("text"))
    own, asked = t.schema[id_col].dataType.simpleString(), phrases.schema[phrase_id].dataType.simpleString()
    schema, out, block, size = f"{id_col} {own}, {phrase_id} {asked}", None, {}, 0

    def search():
        part = t.mapInArrow(_found(spark.sparkContext.broadcast(block), id_col, phrase_id), schema)
        return part if out is None else out.union(part)

    for r in phrases.where(F.length(phrase_col) > 0).select(phrase_id, phrase_col).orderBy(phrase_id).toLocalIterator():
        if size and size + len(r[1]) > block_bytes:
            out = search()
            block, size = {}, 0
        block.setdefault(r[1], []).append(r[0])
        size += len(r[1])
    if block:
        out = search()
    return spark.createDataFrame([], schema) if out is None else out


def _found(block, id_col: str, phrase_id: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for phrase, ids in block.value.items():
            automaton.add_word(phrase, ids)
        automaton.make_automaton()
        for b in batches:
            row, found = [], []
            for k, text in enumerate(b.column(1).to_pylist()):
                hits = {i for _, ids in automaton.iter(text) for i in ids}
                row += [k] * len(hits)
                found += hits
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), pa.array(found)] if found else [b.column(0)[:0], b.column(0)[:0]], names=[id_col, phrase_id])

    return run


def contains_phrase(passages: DataFrame, phrases: DataFrame) -> DataFrame:
    """(pid, phrase) where the lower-cased text holds the phrase anywhere."""
    p = phrases.select("phrase", F.col("phrase").alias("held")).distinct()
    return containing(passages.select("pid", F.lower("text").alias("text")), p, "pid", "phrase", phrase_col="held")


def co_occurrence_label(passages: DataFrame, indicators: DataFrame) -> DataFrame:
    """(pid, word, sense): passages with an indicator of just one of a word's two senses, and the word itself (J11). ``indicators``: word, sense, term."""
    terms = indicators.select(F.col("term").alias("word"), F.col("word").alias("w"), "sense").distinct()
    own = indicators.select("word", F.col("word").alias("w"), F.lit(None).cast(indicators.schema["sense"].dataType).alias("sense")).distinct()
    has = distinct_words(passages).join(F.broadcast(terms.union(own)), "word")  # a configuration; a row without sense says that the word itself is there
    senses = has.groupBy("pid", "w").agg(F.min("sense").alias("lo"), F.max("sense").alias("hi"), F.count(F.when(F.col("sense").isNull(), 1)).alias("itself"))
    return senses.where("lo = hi AND itself > 0").select("pid", F.col("w").alias("word"), F.col("lo").alias("sense"))

