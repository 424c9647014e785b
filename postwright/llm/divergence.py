"""Source divergence audit: how far the sources of a language lie from each other, term by term.

Each (lang, source) group gives every kept term of its language a smoothed share ``p``; two groups are as far
apart as the sum of |p - q| over all kept terms. Most terms are missing in most sources, so the sum starts at a baseline, V times
the difference of the two shares of a count of zero, and an inverted index (term to the groups that have it) sends only
corrections to that:

* a group's own terms against the other's share of zero. This depends on the other group by one number only, so it comes from
  running sums over the group's terms in order of their shares, and no (term, missing group) becomes a row;
* a term that both have: the first corrections took the other's share for one of zero and are set right by the pair's two postings.

A posting list is as long as the sources are many; terms, of which there are far more, share out the work. Counts are taken where the
texts are read and leave as one row a term and group of what a task has seen. All arithmetic is on integers.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postwright.llm._common import only, small_batches, staged

#: Documents of a language that a term must be in to be kept.
LEAST_DOCS = 30
#: Ranks of the term part.
TOP = 50
SMOOTHING = 5
SCALE = 1_000_000_000
#: (group, term) counts that a task holds before it sends them on.
HELD = 400_000
#: Shares of the groups of a language among tasks, when all pairs are made.
DEALT = 32

#: Terms are runs of ASCII letters, lower-cased, and of bytes beyond ASCII.
LETTERS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) to (lang, source, term, n, docs): occurrences of a term and documents that have it, a row for each group and term of what the task holds at once."""
    n: dict[tuple, Counter] = defaultdict(Counter)
    docs: dict[tuple, Counter] = defaultdict(Counter)
    held = 0

    def out():
        langs, sources, terms, ns, ds = [], [], [], [], []
        for (lang, source), own in n.items():
            with_term = docs[lang, source]
            langs += [lang] * len(own)
            sources += [source] * len(own)
            terms += own.keys()
            ns += own.values()
            ds += [with_term[t] for t in own]
        n.clear()
        docs.clear()
        for at in range(0, len(terms), 50_000):
            to = at + 50_000
            columns = [pa.array(x[at:to], pa.binary()) for x in (langs, sources, terms)] + [pa.array(x[at:to], pa.int64()) for x in (ns, ds)]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])

    for b in batches:
        for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            terms, here = text.translate(LETTERS).split(), n[lang, source]
            before = len(here)
            here.update(terms)
            docs[lang, source].update(set(terms))
            held += len(here) - before
            if held > HELD:
                yield from out()
                held = 0
    yield from out()


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (count + 5) / (total + 5 * kept)), exactly; where no term is kept there is no share."""
    wide = "decimal(20,0)"
    over = (total + kept * SMOOTHING).cast(wide)
    return F.when(kept > 0, F.call_function("div", (count + SMOOTHING).cast(wide) * F.lit(SCALE).cast("decimal(11,0)"), over) + 1)


def term_counts(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, source, term, n, docs), names and terms as UTF-8 bytes: what each task has counted, still to be added up. Null counts as empty."""
    small_batches(docs.sparkSession)
    d = only(docs, lang=lang, source=source, text=text)
    d = d.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary").alias(c) for c in ("lang", "source", "text")])
    return d.mapInArrow(_counts, "lang binary, source binary, term binary, n long, docs long")


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """Rows (lang, source, part, item, value, rank) of every (lang, source) group that occurs.

    Part ``pair``: each other source of the language by the summed difference of shares, all of them; part ``term``: the group's terms whose
    share lies over the language's, the first ``top``. Ranks from 1, largest value first, then the item in UTF-8 order. Null lang, source and text
    count as empty strings, an empty text gives its group no term; a language without kept terms has pairs of value 0 and no term rows.
    Repeated rows count as often as they stand there; other columns are ignored; an empty table gives an empty result.
    """
    d = only(docs, lang="lang", source="source")
    groups = staged(d.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct(), "groups")
    counted = term_counts(docs).select(*[F.col(c).cast("string").alias(c) for c in ("lang", "source", "term")], "n", "docs")
    by_group = counted.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")  # a row a source; partitioned as it is already
    kept = by_group.withColumns({"in_lang": F.sum("docs").over(term), "n_lang": F.sum("n").over(term)}).where(F.col("in_lang") >= least_docs)
    kept = staged(kept.select("lang", "source", "term", "n", "n_lang"), "postings")

    # One row a language, one a group: V, both totals and the share of a count of zero.
    size = F.count("*").alias("v"), F.sum("n_lang").alias("total_lang")
    langs = kept.select("lang", "term", "n_lang").distinct().groupBy("lang").agg(*size)
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    stats = groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "v", "total_lang"])
    stats = staged(stats.withColumn("zero", F.coalesce(share(F.lit(0), F.col("total"), F.col("v")), F.lit(0))), "group-stats")

    own = staged(kept.join(stats, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("v"))), "shares")

    # Part term.
    over = own.withColumn("value", F.col("p") - share(F.col("n_lang"), F.col("total_lang"), F.col("v"))).where("value > 0")
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = over.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value").withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top)

    # Part pair. All ordered pairs of a language are rows of the result; each pair's other group is dealt to shares of the first's.
    salt = F.pmod(F.xxhash64("source"), F.lit(DEALT))
    others = stats.select("lang", F.col("source").alias("item"), F.col("zero").alias("zero_item"), F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1)).cast("array<long>")).alias("salt"))
    pairs = stats.select("lang", "source", "zero", "v", salt.alias("salt")).join(others, ["lang", "salt"]).where("source <> item").drop("salt")
    pairs = staged(pairs, "group-pairs")

    # A group's own terms against the other's zero: below it the difference is shorter by p - zero, from it on longer by p + zero - 2 * zero_item.
    stops = pairs.where("zero_item > zero").select("lang", "source", F.col("zero_item").alias("p"), F.lit(0).alias("is_term"), "item", "zero")
    steps = own.select("lang", "source", "p", F.lit(1).alias("is_term"), F.lit(None).cast("string").alias("item"), "zero").union(stops)
    from_here = Window.partitionBy("lang", "source").orderBy(F.desc("p")).rangeBetween(Window.unboundedPreceding, 0)
    rise = F.sum(F.when(F.col("is_term") == 1, F.col("p") - F.col("zero")))
    above = steps.withColumns({"n_above": F.sum("is_term").over(from_here), "rise_above": F.coalesce(rise.over(from_here), F.lit(0))}).where("is_term = 0")
    excess = own.groupBy("lang", "source").agg(F.sum(F.col("p") - F.col("zero")).alias("rise"))
    alone = (
        pairs.join(excess, ["lang", "source"], "left").join(above.select("lang", "source", "item", "n_above", "rise_above"), ["lang", "source", "item"], "left")
        .withColumn("rise", F.coalesce("rise", F.lit(0)))
        # Terms over the other's zero: (p - z') - (z' - z) = rise + 2 z - 2 z' each; those under it: -(p - z).
        .withColumn("own", F.when(F.col("zero_item") <= F.col("zero"), F.col("rise")).otherwise(
            2 * F.col("rise_above") - 2 * F.col("n_above") * (F.col("zero_item") - F.col("zero")) - F.col("rise")))
        .select("lang", "source", "item", "own")
    )
    # Terms that two groups share: each pair once, the sums of a task before they move.
    one = own.select("lang", "term", "source", "p", "zero")
    two = one.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("zero").alias("z"))
    off = F.abs(F.col("p") - F.col("q")) - F.abs(F.col("p") - F.col("z")) - F.abs(F.col("zero") - F.col("q")) + F.abs(F.col("zero") - F.col("z"))
    both = one.join(two, ["lang", "term"]).where("source < item").select("lang", "source", "item", off.alias("off")).where("off <> 0")
    both = staged(both.groupBy("lang", "source", "item").agg(F.sum("off").alias("own")), "shared-terms")
    turned = lambda t: t.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "own")
    corrections = alone.union(turned(alone)).union(both).union(turned(both)).groupBy("lang", "source", "item").agg(F.sum("own").alias("own"))
    value = F.col("v") * F.abs(F.col("zero") - F.col("zero_item")) + F.coalesce("own", F.lit(0))
    found = pairs.join(corrections, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", value.cast("long").alias("value"))
    found = found.withColumn("rank", F.row_number().over(by_value))
    return found.union(terms)
