"""How the sources of a language differ in their words: a divergence of every pair of sources, and each source's own terms.

Terms are counted by language and source within each Arrow batch (exact, by dictionary), so a row of the first shuffle is
a term that a batch has, not an occurrence; partial sums follow. A language keeps the terms of enough of its documents.

A group's share of a term is p = 1 + floor(scale (count + 1) / (N + V)), its divergence from another's share q is
f = floor((p - q)^2 / q), and of a pair of groups the sum over all V kept terms is wanted, also of those that neither has.
It is found by inclusion and exclusion over the groups' supports:

* Terms that a group has, priced as if the other had none of them: p depends on the count alone, so the group's histogram
  of counts is enough, and it is priced against each other group's constant share of an absent term.
* The same for the other group. Terms of both have been counted on either side, so a join of postings by term corrects
  each by f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0).
* What is left, V less both supports (the correction above adds the overlap back), is a constant each.

The postings of a term meet in slices of its sources when it has many (see ``slice_size``), so one term that all sources
have is spread over tasks. All arithmetic is of whole numbers; a sum beyond 64 bits is an error, not a wrong figure.

Null text, lang and source are as ''. Every row is a document of its own, repeated ones and those without an id too. A
group whose documents hold no term has a row for each other source. A single source has no pair. Empty table: no rows.
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import release, slices, small_batches, text_buffers, written

#: Bytes of terms: letters of ASCII, and every byte of other characters.
_TERM = np.zeros(256, bool)
_TERM[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32

COUNTS = "lang string, source string, term string, n long, d long"


def terms(raw: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The terms of texts in order, as a dictionary array, and the number of the text of each."""
    inside = _TERM[raw]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    full = offsets[:-1] < offsets[1:]
    begin, end = offsets[:-1][full], offsets[1:][full] - 1
    first[begin] = inside[begin]  # a term ends where its text does
    last[end] = inside[end]
    start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
    data = _LOWER[raw[inside]]
    at = np.concatenate([[0], np.cumsum(stop - start)]).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(at), pa.py_buffer(data))
    return words.dictionary_encode(), np.searchsorted(offsets, start, side="right") - 1


def _grouped(keys: np.ndarray, values: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[at], [np.add.reduceat(v[order], at) if len(at) else v for v in values]


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, term, n (occurrences), d (documents)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offsets = text_buffers(b.column(0))
            groups = pa.StructArray.from_arrays([b.column(1), b.column(2)], ["lang", "source"])
            names = list(dict.fromkeys(map(tuple, (x.values() for x in groups.to_pylist()))))
            number = {x: i for i, x in enumerate(names)}
            of_row = np.fromiter((number[tuple(x.values())] for x in groups.to_pylist()), np.int64, len(b))
            for i, j in slices(offsets, 1 << 22):
                coded, row = terms(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                size = len(coded.dictionary)
                if not size:
                    continue
                per_text, (n,) = _grouped(row * size + coded.indices.to_numpy(), [np.ones(len(row), np.int64)])
                keys, (n, d) = _grouped(of_row[i + per_text // size] * size + per_text % size, [n, np.ones(len(n), np.int64)])
                group, word = keys // size, keys % size
                yield pa.RecordBatch.from_arrays(
                    [pa.array([names[g][k] for g in group], pa.string()) for k in (0, 1)] + [pc.take(coded.dictionary, pa.array(word)).cast(pa.string()), pa.array(n), pa.array(d)],
                    ["lang", "source", "term", "n", "d"],
                )
        release()

    small_batches(docs.sparkSession)
    columns = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(k) for c, k in ((text, "text"), (lang, "lang"), (source, "source"))]
    made = docs.select(*columns).mapInArrow(run, COUNTS)
    return made.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def share(count: Column, total: Column, terms: Column, scale: int) -> Column:
    """1 + floor(scale (count + 1) / (total + terms)); null where both are 0."""
    whole = lambda c: c.cast("decimal(20,0)")  # noqa: E731  scale times a count may be beyond 64 bits
    of = total + terms
    up = (whole(count) + 1) * F.lit(scale).cast("decimal(11,0)")
    return F.when(of > 0, F.call_function("div", up, whole(F.when(of > 0, of)))) + 1


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def source_divergence(docs: DataFrame, least_documents: int = 3, top: int = 200, scale: int = 1_000_000_000, slice_size: int = 64, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank: see above. Eager up to the term counts."""
    group = ["lang", "source"]
    counts = written(term_counts(docs, text, lang, source), "term-counts")
    by_term = Window.partitionBy("lang", "term")
    in_lang = counts.withColumns({"in_documents": F.sum("d").over(by_term), "lang_n": F.sum("n").over(by_term), "place": F.row_number().over(by_term.orderBy("source")) - 1})
    kept = in_lang.where(F.col("in_documents") >= least_documents).drop("d", "in_documents")

    # Every group with its totals: V and the language's N come from the postings, each term once, at its first source.
    named = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(k) for c, k in ((lang, "lang"), (source, "source"))]).distinct()
    sums = kept.groupBy(*group).agg(F.sum("n").alias("total"), F.count("*").alias("support"), F.count_if(F.col("place") == 0).alias("firsts"))
    zero = {"total": 0, "support": 0, "firsts": 0}
    all_groups = named.join(sums, group, "left").fillna(zero)
    of_lang = all_groups.groupBy("lang").agg(F.sum("firsts").alias("v"), F.sum("total").alias("lang_total"))
    all_groups = written(all_groups.drop("firsts").join(of_lang, "lang").withColumn("p0", share(F.lit(0), F.col("total"), F.col("v"), scale)), "groups")

    share_of = share(F.col("n"), F.col("total"), F.col("v"), scale)
    postings = written(kept.join(all_groups, group).select(*group, "term", "n", "lang_n", "place", "lang_total", "v", "p0", share_of.alias("p")), "postings")

    # One-sided terms: a group's histogram of counts against every other group's share of an absent term.
    other = all_groups.select(F.col("lang").alias("o_lang"), F.col("source").alias("item"), F.col("p0").alias("q0"), F.col("support").alias("o_support"))
    paired = lambda df: df.join(other, (F.col("lang") == F.col("o_lang")) & (F.col("source") != F.col("item"))).drop("o_lang")
    pair = ["lang", "source", "item"]
    histogram = postings.groupBy(*group, "p", "p0").agg(F.count("*").alias("terms"))
    one_sided = paired(histogram)
    here = one_sided.select(*pair, (F.col("terms") * divergence(F.col("p"), F.col("q0"))).alias("x"))
    there = one_sided.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), (F.col("terms") * divergence(F.col("q0"), F.col("p"))).alias("x"))

    # Terms of both: postings of a term meet slice by slice.
    left = postings.withColumn("slice", F.floor(F.col("place") / slice_size))
    size = postings.where(f"place % {slice_size} = 0").groupBy("lang", "term").agg(F.max(F.floor(F.col("place") / slice_size)).alias("slices"))
    right = postings.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("p0").alias("q0"), F.floor(F.col("place") / slice_size).alias("o_slice"))
    many = size.where("slices > 0")
    spread = left.join(many, ["lang", "term"], "left").withColumn("o_slice", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("slices", F.lit(0).cast("long"))))).drop("slices")
    met = spread.join(right, ["lang", "term", "o_slice"]).where(F.col("source") != F.col("item"))
    p, q, p0, q0 = (F.col(c) for c in ("p", "q", "p0", "q0"))
    both = met.select(*pair, (divergence(p, q) - divergence(p, q0) - divergence(p0, q) + divergence(p0, q0)).alias("x"))

    # Terms of neither.
    constant = F.when(F.col("v") > 0, (F.col("v") - F.col("support") - F.col("o_support")) * divergence(F.col("p0"), F.col("q0"))).otherwise(0)
    neither = paired(all_groups).select(*pair, constant.cast("long").alias("x"))

    sums = reduce(DataFrame.unionAll, [x.groupBy(*pair).agg(F.sum("x").alias("x")) for x in (here, there, both)] + [neither])
    pairs = sums.groupBy(*pair).agg(F.sum("x").cast("long").alias("value"))

    q_lang = share(F.col("lang_n"), F.col("lang_total"), F.col("v"), scale)
    own = postings.withColumn("q", q_lang).where("p > q").select(*group, F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))
    place = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("value"), "item"))
    ranked = lambda df, part: df.withColumn("rank", place).select(*group, F.lit(part).alias("part"), "item", "value", "rank")
    return ranked(pairs, "pair").unionAll(ranked(own, "term").where(F.col("rank") <= top))
