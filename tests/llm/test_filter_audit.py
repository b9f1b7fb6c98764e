"""The audit of filter orders against applying the filters one after another."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

from tidemark.llm import filter_audit as fa

SCHEMA = "doc_id long, text string, lang string, mask int, good string"
LONG = " ".join(f"w{i}" for i in range(120))


def fails(text):
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", text) if w]
    return {
        "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text),
        "D": any(c in "#$%&*|" for c in text),
    }


def brute(docs, labels):
    """docs: (doc_id, text, lang); labels: (doc_id, quality, toxic)."""
    rows = []
    for ident, text, lang in docs:
        text = text or ""
        f = fails(text)
        f["E"] = ident is not None and any(o is not None and o < ident and (t or "") == text for o, t, _ in docs)
        own = [x for x in labels if x[0] is not None and x[0] == ident]
        rows.append((lang or "", f, any(q == 1 for _, q, _ in own), any(t == 1 for _, _, t in own)))
    out, shapley = {}, {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        for order in itertools.permutations("ABCDE"):
            left = mine
            for k, name in enumerate(order):
                gone = [r for r in left if r[1][name]]
                rest = [r for r in left if not r[1][name]]
                out[part, "".join(order), k + 1] = [
                    len(rest), len(gone), sum(r[1][name] for r in mine) - len(gone), sum(r[1][name] and not any(r[1][o] for o in order if o != name) for r in mine),
                    sum(r[2] for r in gone), sum(r[3] for r in gone),
                ]
                shapley[part, name] = shapley.get((part, name), 0) + len(gone)
                left = rest
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def result(spark, docs, labels):
    d = spark.createDataFrame([(*x, "clash", True) for x in docs], "doc_id long, text string, lang string, mask string, good boolean")
    lab = spark.createDataFrame([(*x, "x") for x in labels], "doc_id long, quality int, toxic int, n string")
    got = fa.filter_interactions(d, lab).collect()
    return {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got}


def test_all_orders_against_brute_force(spark):
    docs = [
        (1, LONG, "en"), (2, LONG, "de"), (3, LONG, "en"), (4, "SHOUT " * 150, "en"), (5, "", "en"), (6, None, "en"), (7, "a b | c", None),
        (8, LONG + " $", "en"), (9, LONG + " $", "de"), (9, LONG + " $", "de"), (None, LONG, "en"), (None, LONG, "en"), (0, "", "de"), (10, "ÄÖ " * 130, "fr"), (11, "\x0b\x1c x", "fr"),
        (12, "A" * 11 + "b" * 89, "en"), (13, "A" * 10 + "b" * 90, "en"),
    ]
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, None), (3, None, None), (4, 1, 1), (5, 1, 0), (9, 1, 1), (None, 1, 1), (99, 1, 1)]
    got, want = result(spark, docs, labels), brute(docs, labels)
    assert got == want and len(got) == 600 * len({x[2] or "" for x in docs})


def test_hot_text_and_empty_tables(spark):
    docs = [(i, "copy", "en" if i % 2 else "de") for i in range(300)] + [(1000 + i, f"{i} {LONG}", "en") for i in range(20)]
    assert result(spark, docs, []) == brute(docs, [])
    assert result(spark, [], [(1, 1, 1)]) == {}


def test_survivors_are_sums_over_subsets(spark):
    counts = [3, 1, 4, 1, 5, 9, 2, 6]
    got = spark.range(1).select(fa.subset_sums(F.array(*map(F.lit, counts)), 3)).first()[0]
    assert got == [sum(counts[m] for m in range(8) if m & ~s == 0) for s in range(8)]


def test_shapley_of_all_orders_is_the_removed_total(spark):
    docs = [(i, ("x $ " if i % 3 else "x ") * (i % 5), "en") for i in range(40)]
    got = result(spark, docs, [])
    removed = 40 - got["en", "ABCDE", 5][0]
    assert sum(got["en", "ABCDE", k][6] for k in range(1, 6)) == removed * math.factorial(5)


@pytest.mark.parametrize("text", ["a\x85b", "tab\there", " lead trail ", "\n\n", "x" * 100_000])
def test_words_and_capitals(spark, text):
    df = spark.createDataFrame([(text,)], "t string").select(*[c.alias(k) for k, c in fa.contract_failures(F.col("t")).items()])
    assert df.first().asDict() == fails(text)
