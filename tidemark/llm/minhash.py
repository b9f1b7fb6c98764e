"""Near-duplicate documents by MinHash with tensored banding, links confirmed on full shingle sets.

Signature: two collections of GROUPS groups of ROWS minhashes each. Table (i, j) is keyed by group i of the first
collection with group j of the second, so GROUPS^2 tables of 2*ROWS rows cost 2*GROUPS*ROWS minhashes instead of
2*GROUPS^2*ROWS. Two sets of Jaccard similarity s share a table with probability (1 - (1 - s^ROWS)^GROUPS)^2.

1. One row a document: shingle count, a 128-bit fingerprint of the set, the group hashes.
2. Documents with one set are a class; only its smallest id goes on. Copies are never expanded into pairs.
3. Every class emits its table keys. In a bucket each member is compared with the smallest member only, so a bucket
   of n gives n-1 candidates. They are confirmed on the full sets, and components are formed.
4. The rest, exactly: where a bucket still holds members of different components, all members of such buckets go
   through a prefix-filter join (shingles in order of rarity; two sets that meet the threshold share one among their
   first few, at positions that leave room for the overlap needed), only across components; what it finds is confirmed
   too. This has no cap. Components are paired by bounds on their members before members are, so members of one
   component are never paired. Components that share a prefix shingle are compared by those bounds within the join,
   which is quadratic in their number for that shingle; only pairs within the bounds leave it.
5. Components of all confirmed links, spread over the classes' members.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. Fewer words than a shingle: the whole sequence is one.
Null or wordless text: empty set, linked with nothing, kept. Rows that repeat an id are one document, whose text is the
least of theirs (null: empty), and come back each. Rows with a null id are linked with nothing and come back with a null
component, kept. Empty table: empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_written, mix64, release, shingle_hashes, slices, small_batches, text_buffers, word_hashes, written
from .components import components

GROUPS, ROWS = 9, 2
_rng = np.random.default_rng(20)
_XOR = _rng.integers(0, 2**64, (2 * GROUPS, ROWS), dtype=np.uint64)
_MUL = _rng.integers(0, 2**63, (2 * GROUPS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SIGNATURE = "doc_id long, n_shingles long, fp1 long, fp2 long, first array<long>, second array<long>"


def _sets(text: pa.Array, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from row, to row, concatenated sets, offsets) over slices of the texts."""
    raw, at = text_buffers(text)
    for i, j in slices(at):
        words, _, _, row = word_hashes(raw[at[i] : at[j]], at[i : j + 1] - at[i])
        yield (i, j, *shingle_hashes(words, row, j - i, size))


def _signatures(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, sets, at in _sets(b.column(1), size):
                n, count = j - i, np.diff(at)
                full = np.flatnonzero(count)
                groups = np.zeros((n, 2 * GROUPS), np.uint64)
                fp = np.zeros((n, 2), np.uint64)
                if len(full):
                    starts = at[:-1][full]
                    fp[full, 0] = np.add.reduceat(mix64(sets), starts)
                    fp[full, 1] = np.add.reduceat(mix64(sets ^ _XOR[0, 0]), starts)
                    for g in range(2 * GROUPS):
                        h = np.zeros(len(full), np.uint64)
                        for r in range(ROWS):
                            h = mix64(h ^ np.minimum.reduceat((sets ^ _XOR[g, r]) * _MUL[g, r], starts))
                        groups[full, g] = h
                lists = [pa.ListArray.from_arrays(pa.array(np.where(np.arange(n + 1), np.concatenate([[0], np.cumsum((count > 0) * GROUPS)]), 0).astype(np.int32)), pa.array(groups[full, c * GROUPS : (c + 1) * GROUPS].ravel().view(np.int64))) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, n), pa.array(count.astype(np.int64)), pa.array(fp[:, 0].view(np.int64)), pa.array(fp[:, 1].view(np.int64)), *lists], [x.split()[0] for x in SIGNATURE.split(", ")])
        release()

    return run


def _shingles(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, sets, at in _sets(b.column(1), size):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(sets.view(np.int64)))], ["doc_id", "shingles"])
        release()

    return run


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets meet the threshold."""
    sa, sb = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa")), sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.select("a", "b").join(sa, "a").join(sb, "b").withColumn("both", F.size(F.array_intersect("sa", "sb")))
    return both.where(F.col("both") * 100 >= (F.size("sa") + F.size("sb") - F.col("both")) * percent).select("a", "b")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable over links with 100 * intersection >= percent * union),
    kept. Eager up to the component tables."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    texts, nameless = rows.where("doc_id is not null"), rows.where("doc_id is null")
    repeats = written(texts.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "repeats")
    repeated = repeats.limit(1).count() > 0
    if repeated:
        many = texts.join(repeats, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
        texts = texts.join(repeats, "doc_id", "left_anti").unionByName(many)
    sigs = written(texts.mapInArrow(_signatures(size), SIGNATURE), "signatures")
    classes = sigs.where("n_shingles > 0").groupBy("n_shingles", "fp1", "fp2").agg(F.min("doc_id").alias("rep"), F.any_value("first").alias("first"), F.any_value("second").alias("second"))
    classes = written(classes, "classes")

    tables = F.flatten(F.transform("first", lambda x, i: F.transform("second", lambda y, j: F.xxhash64(x, y, i, j))))
    keys = classes.select(F.col("rep").alias("doc"), F.col("n_shingles").alias("n"), F.explode(tables).alias("bucket"))
    shared = keys.groupBy("bucket").agg(F.min("doc").alias("head"), F.count("*").alias("members")).where("members > 1")
    members = written(keys.join(shared, "bucket").select("bucket", "doc", "n", "head"), "buckets")

    # The full sets of classes that share a bucket; the texts are read again rather than all sets kept.
    wanted = members.select(F.col("doc").alias("doc_id")).distinct()
    sets = written(texts.join(wanted, "doc_id", "left_semi").dropDuplicates(["doc_id"]).mapInArrow(_shingles(size), "doc_id long, shingles array<long>"), "sets")

    heads = classes.select(F.col("rep").alias("head"), F.col("n_shingles").alias("head_n"))
    stars = members.where("doc <> head").select("head", "doc", "n").distinct().join(heads, "head")
    stars = stars.where(F.least("n", "head_n") * 100 >= F.greatest("n", "head_n") * percent).select(F.col("doc").alias("a"), F.col("head").alias("b"))
    links = written(_confirm(stars, sets, percent), "links")
    found = components(links)

    # Buckets whose members are in different components yet.
    named = members.join(found, members.doc == found.node, "left").select("bucket", "doc", "n", F.coalesce("component", "doc").alias("component"))
    open_ = named.groupBy("bucket").agg((F.min("component") != F.max("component")).alias("open")).where("open").select("bucket")
    # Written, as is the prefix below: each is read several times, and a plan that repeats all of what they are made from
    # starts its exchanges at once, each with a thread and memory of the driver.
    rest = written(named.join(open_, "bucket").select("doc", "n", "component").distinct(), "rest")
    words = rest.join(sets, rest.doc == sets.doc_id).select("doc", "n", "component", F.explode("shingles").alias("w"))
    rarity = words.groupBy("w").agg(F.count("*").alias("df")).where("df > 1")
    # A shingle of one set alone joins nothing; it only takes a place at the front of its set's order.
    common = words.join(rarity, "w")
    order = Window.partitionBy("doc").orderBy("df", "w")
    alone = F.col("n") - F.count("*").over(Window.partitionBy("doc"))
    ranked = common.withColumn("at", alone + F.row_number().over(order) - 1)
    prefix = ranked.where(F.col("n") - F.col("at") >= F.ceil(F.col("n") * percent / 100.0 - 1e-9)).select("w", "doc", "n", "component", "at")
    prefix = written(prefix, "prefix")
    # Components are paired before members are, by bounds that hold for all their members, so that the members of a
    # large component never meet each other.
    owners = prefix.groupBy("w", "component").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max(F.col("n") - F.col("at")).alias("room"))
    one, two = (owners.select("w", *[F.col(c).alias(f"{c}{k}") for c in ("component", "low", "high", "room")]) for k in (1, 2))

    def need(n1: str, n2: str):
        return F.ceil((F.col(n1) + F.col(n2)) * percent / (100.0 + percent) - 1e-9)

    apart = one.join(two, "w").where((F.col("component1") < F.col("component2")) & (F.col("high1") * 100 >= F.col("low2") * percent) & (F.col("high2") * 100 >= F.col("low1") * percent) & (F.least("room1", "room2") >= need("low1", "low2")))
    left, right = (prefix.select("w", *[F.col(c).alias(f"{c}{k}") for c in ("doc", "n", "component", "at")]) for k in (1, 2))
    pairs = apart.join(left, ["w", "component1"]).where(F.least(F.col("n1") - F.col("at1"), "room2") >= need("n1", "low2"))
    pairs = pairs.join(right, ["w", "component2"]).where(F.least(F.col("n1") - F.col("at1"), F.col("n2") - F.col("at2")) >= need("n1", "n2"))
    pairs = pairs.select(F.greatest("doc1", "doc2").alias("a"), F.least("doc1", "doc2").alias("b")).distinct()
    more = _confirm(pairs, sets, percent)
    last = written(components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more)), "components")

    # A class without a link to another is its own component.
    classed = classes.join(last, classes.rep == last.node, "left").select("n_shingles", "fp1", "fp2", F.coalesce("component", "rep").alias("component_id"))
    ids = sigs.select("doc_id", "n_shingles", "fp1", "fp2")
    out = ids.where("n_shingles > 0").join(classed, ["n_shingles", "fp1", "fp2"]).select("doc_id", "n_shingles", "component_id")
    out = out.union(ids.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    for t in (members, sets, links, rest, prefix):
        drop_written(t)
    if repeated:
        again = rows.select("doc_id").join(repeats, "doc_id", "left_semi").join(out, "doc_id")
        out = out.join(repeats, "doc_id", "left_anti").unionByName(again)
    lone = nameless.mapInArrow(_signatures(size), SIGNATURE).select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"))
    return out.union(lone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
