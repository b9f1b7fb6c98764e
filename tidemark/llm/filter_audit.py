"""Interaction of document filters: what each of them removes, in every order, by part.

Every document becomes a mask of the filters that it fails. Documents are counted by part, mask and label, which is at
most 128 rows a part whatever the input; all else is computed from these counts. A subset-zeta transform turns a part's
mask counts into survivors[S], the number of documents that fail no filter of S, for all 32 subsets S. A step of an order
that applies filter f after the filters S then removes survivors[S] - survivors[S + f], and likewise for labelled ones.

Filters are given as columns; the last one may be exact repetition, which needs the corpus. It is decided without a join
of the documents with themselves: those with one text are counted by part, mask and label (partial counts before the
shuffle, so a text that a third of all rows hold is a few rows a task), and of those counts the one with the smallest id
keeps the rows of that id. Texts are compared by SHA-256.

A null text is an empty one, a null part is ''. Rows without an id repeat nothing and are repeated by nothing; rows that
share an id and a text do not repeat each other (no id is smaller). A document counts as good or toxic if any of its
labels says so. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import itertools
import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def contract_failures(text: Column) -> dict[str, Column]:
    """The filters A to D over a whole text: few words, few distinct words, many capitals, marks."""
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    n = F.size(words).cast("long")
    return {
        "A": n < 100,
        "B": F.size(F.array_distinct(words)).cast("long") * 100 < n * 80,
        "C": F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long") * 100 > F.length(text).cast("long") * 10,
        "D": text.rlike("[#$%&*|]"),
    }


def masks(docs: DataFrame, failures: dict[str, Column], text: Column, part: Column, ident: Column) -> DataFrame:
    """ident, part, mask (bit i: it fails the i-th filter) and the text's digest, a narrow row a document."""
    mask = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(failures.values())), F.lit(0))
    return docs.select(ident.cast("long").alias("id"), F.coalesce(part.cast("string"), F.lit("")).alias("part"), mask.cast("int").alias("mask"), F.unhex(F.sha2(text, 256)).alias("digest"))


def counted(rows: DataFrame, labels: DataFrame, repeat_bit: int) -> DataFrame:
    """part, mask, good, toxic, n: masks() rows with the bit of exact repetition added, counted.

    labels: id, good, toxic (boolean)."""
    lab = labels.groupBy(F.col("id").alias("l_id")).agg(F.coalesce(F.bool_or("good"), F.lit(False)).alias("good"), F.coalesce(F.bool_or("toxic"), F.lit(False)).alias("toxic"))
    marked = rows.join(lab, F.col("id") == F.col("l_id"), "left").fillna(False, ["good", "toxic"])
    keys = ["digest", "part", "mask", "good", "toxic"]
    # Rows that share an id and a text first, so that the smallest id of a count comes with its number of rows.
    each = marked.groupBy(*keys, "id").agg(F.count("*").alias("n"))
    least = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n")))
    by_text = each.groupBy(*keys).agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias("n_null"), least.alias("least"))
    first = F.min("least.id").over(Window.partitionBy("digest"))
    kept = F.col("n_null") + F.when(F.col("least.id") == first, F.col("least.n")).otherwise(0)
    both = by_text.withColumn("kept", kept).select("part", "mask", "good", "toxic", F.explode(F.array(
        F.struct(F.lit(0).alias("bit"), F.col("kept").alias("n")), F.struct(F.lit(repeat_bit).alias("bit"), (F.col("n") - F.col("kept")).alias("n")))).alias("x"))
    return both.groupBy("part", (F.col("mask") + F.col("x.bit")).alias("mask"), "good", "toxic").agg(F.sum("x.n").alias("n"))


def subset_sums(counts: Column, bits: int) -> Column:
    """Subset-zeta transform: of an array over masks, at each mask the sum over all masks within it, a bit a round."""
    add = lambda now, bit: F.transform(now, lambda x, at: F.when(at.bitwiseAND(bit) != 0, x + F.get(now, at - bit)).otherwise(x))
    return F.aggregate(F.array(*[F.lit(1 << i) for i in range(bits)]), counts, add)


def audit(counts: DataFrame, names: str) -> DataFrame:
    """Rows part, filter_order, step and the figures for all orders of the filters. counts: see counted()."""
    bits, full = len(names), (1 << len(names)) - 1
    of = lambda keep: F.array(*[F.coalesce(F.sum(F.when((F.col("mask") == m) & keep, F.col("n"))), F.lit(0)).cast("long") for m in range(full + 1)])
    per_part = counts.groupBy("part").agg(of(F.lit(True)).alias("c_all"), of(F.col("good")).alias("c_good"), of(F.col("toxic")).alias("c_toxic"))
    # Survivors of S are the masks within the complement of S: the transform read from its end.
    per_part = per_part.select("part", *[F.reverse(subset_sums(F.col(f"c_{k}"), bits)).alias(k) for k in ("all", "good", "toxic")])
    weight = [math.factorial(s.bit_count()) * math.factorial(bits - 1 - s.bit_count()) for s in range(full)]  # orders that apply s, then a filter out of s
    shapley = F.array(*[sum((F.col("all")[s] - F.col("all")[s | 1 << f]) * weight[s] for s in range(full) if not s >> f & 1) for f in range(bits)])
    steps = []
    for order in itertools.permutations(range(bits)):
        before = 0
        for k, f in enumerate(order):
            steps.append({"o": "".join(names[i] for i in order), "k": k + 1, "f": f, "before": before, "after": before | 1 << f})
            before |= 1 << f
    table = F.from_json(F.lit(json.dumps(steps)), "array<struct<o string, k int, f int, before int, after int>>")  # as many rows as there are steps
    rows = per_part.withColumn("shapleys", shapley).select("*", F.explode(table).alias("s"))
    at = lambda kind, s: F.get(F.col(kind), s)
    f, before, after = F.col("s.f"), F.col("s.before"), F.col("s.after")
    bit = F.get(F.array(*[F.lit(1 << i) for i in range(bits)]), f)
    removed = at("all", before) - at("all", after)
    return rows.select(
        "part", F.col("s.o").alias("filter_order"), F.col("s.k").alias("step"), at("all", after).alias("kept"), removed.alias("removed"),
        (at("all", F.lit(0)) - at("all", bit) - removed).alias("redundant"), (at("all", F.lit(full) - bit) - at("all", F.lit(full))).alias("unique_fails"),
        (at("good", before) - at("good", after)).alias("good_lost"), (at("toxic", before) - at("toxic", after)).alias("toxic_lost"), F.get("shapleys", f).alias("shapley"),
    )


def filter_interactions(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """The audit of the filters A to D of contract_failures() and E, repetition of a text with a smaller id."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = masks(docs, contract_failures(text), text, F.col(part_col), F.col(id_col))
    lab = labels.select(F.col(id_col).cast("long").alias("id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    return audit(counted(rows, lab, 1 << 4), "ABCDE")
