"""The divergence of sources against the plain sum over all terms of every pair."""

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from tidemark.llm import divergence as dv
from tidemark.llm.common import text_buffers

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return [w.translate(LOWER) for w in TERM.findall(text or "")]


def brute(docs, least=3, top=200, scale=10**9):
    docs = [(t, lang or "", source or "") for t, lang, source in docs]
    out = []
    for lang in {x[1] for x in docs}:
        own = [(words(t), s) for t, l2, s in docs if l2 == lang]
        df = Counter(w for ws, _ in own for w in set(ws))
        kept = sorted(w for w, n in df.items() if n >= least)
        counts = defaultdict(Counter)
        for ws, s in own:
            counts[s].update(w for w in ws if df[w] >= least)
        everything = sum(counts.values(), Counter())

        def share(c, term, v=len(kept)):
            return 1 + scale * (c[term] + 1) // (c.total() + v)

        for s in counts:
            f = lambda p, q: (p - q) ** 2 // q
            pairs = [(o, sum(f(share(counts[s], t), share(counts[o], t)) for t in kept)) for o in counts if o != s]
            terms = [(t, f(share(counts[s], t), share(everything, t))) for t in kept if counts[s][t] > 0 and share(counts[s], t) > share(everything, t)]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(items[:most])]
    return sorted(out)


def result(spark, docs, **more):
    df = spark.createDataFrame([(*x, 3, "t") for x in docs], "text string, lang string, source string, n long, term string").repartition(3)
    return sorted(tuple(r) for r in dv.source_divergence(df, **more).collect())


def random_docs(seed, n, sources, vocabulary):
    rng = np.random.default_rng(seed)
    names = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(vocabulary)]
    hot = lambda: 0 if rng.random() < 0.4 else int(rng.integers(sources))
    return [(" ".join(names[min(int(k), vocabulary - 1)] for k in rng.geometric(0.05, int(rng.integers(0, 40)))), str(rng.choice(["en", "de"])), f"s{hot()}") for _ in range(n)]


def test_against_all_terms_of_all_pairs(spark):
    docs = random_docs(3, 200, 7, 120)
    docs += [(None, "en", "s1"), ("", None, None), ("word word", "fr", "only"), ("A b\x00c É é-d_e", None, "s2"), ("a É", "", "s2"), ("É a é", None, "s3"), ("12 34", "en", "silent"), ("x", "de", None)]
    docs += [docs[0]] * 3
    assert result(spark, docs) == brute(docs)


def test_terms_of_many_sources_meet_slice_by_slice(spark):
    docs = random_docs(8, 150, 11, 30)
    assert result(spark, docs, slice_size=3) == brute(docs) == result(spark, docs, slice_size=1)


def test_few_ranks_and_another_scale(spark):
    docs = random_docs(9, 120, 4, 60)
    assert result(spark, docs, top=5, scale=1000, least_documents=2) == brute(docs, 2, 5, 1000)


def test_no_kept_terms_and_empty_table(spark):
    docs = [("one two", "en", "a"), ("three", "en", "b"), ("", "en", "c")]
    got = result(spark, docs)
    assert got == brute(docs) and {r[4] for r in got} == {0} and len(got) == 6
    assert result(spark, []) == []


def test_large_counts_stay_exact(spark):
    """Counts of which a thousand million times is beyond 64 bits."""
    from pyspark.sql import functions as F

    n, total, v = 10**13 + 7, 3 * 10**13 + 1, 12345
    got = spark.createDataFrame([(n, total, v)], "n long, t long, v long").select(dv.share(F.col("n"), F.col("t"), F.col("v"), 10**9)).first()[0]
    assert got == 1 + 10**9 * (n + 1) // (total + v)


def test_terms_of_texts():
    texts = ["Ab1cD", "", "x", "yÉz", "-", "tail"]
    raw, offsets = text_buffers(pa.array(texts))
    coded, row = dv.terms(raw, offsets)
    want = [(i, w) for i, t in enumerate(texts) for w in words(t)]
    assert list(zip(row.tolist(), coded.cast(pa.large_string()).to_pylist(), strict=True)) == want
