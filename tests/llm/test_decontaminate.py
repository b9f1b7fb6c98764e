"""Leaks against dynamic programming over whole texts."""

import random
import re

import numpy as np
import pyarrow as pa

from tidemark.llm import decontaminate as dc
from tidemark.llm.common import text_buffers, word_hashes
from tidemark.llm.decontaminate import EDITS, _myers, clean_documents, find_leaks


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())


def sellers(item, text):
    """Least edit distance of the item to any span of the text."""
    row, best = list(range(len(item) + 1)), len(item)
    for c in text:
        new = [0]
        for i, x in enumerate(item):
            new.append(min(row[i] + (x != c), row[i + 1] + 1, new[i] + 1))
        row = new
        best = min(best, row[-1])
    return best


def test_bit_parallel_distance():
    rng = random.Random(0)
    for _ in range(200):
        a, b = [rng.randrange(4) for _ in range(rng.randint(1, 9))], [rng.randrange(4) for _ in range(rng.randint(1, 20))]
        assert min([len(a), *_myers(a, b, True)]) == sellers(a, b)


def test_against_brute_force(spark):
    rng = random.Random(9)
    vocab = ["the", "of", "and", "in"] * 12 + [f"v{i}" for i in range(200)]
    say = lambda n: rng.choices(vocab, k=n)
    items = [(i, " ".join(say(rng.randint(8, 60)))) for i in range(30)] + [(50, None), (51, ""), (52, "the of"), (55, "v7"), (56, "v3 v3 in and"), (53, "dup " * 9), (54, "dup " * 9)]
    docs = []
    for i in range(400):
        w = say(rng.randint(0, 120))
        if i % 2:
            p = words(items[rng.randrange(30)][1])
            for _ in range(rng.randint(0, int(0.3 * len(p)))):
                x = rng.randrange(len(p))
                p[x : x + 1] = rng.choice([[], [rng.choice(vocab)], [p[x], rng.choice(vocab)]])
            p = p or ["x"]
            at = rng.randint(0, len(w))
            w = w[:at] + [x.upper() if rng.random() < 0.1 else x for x in p] + w[at:]
        docs.append((i, " ".join(w)))
    docs += [(500, None), (501, ""), (502, "dup " * 30_000), (503, "a " * 60_000 + items[3][1]), (503, "a " * 60_000 + items[3][1])]
    df = spark.createDataFrame([(i, t, 1, "k") for i, t in docs], "doc_id long, text string, item_id int, distance string").repartition(3)
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int")
    rows = find_leaks(df, bench).collect()
    got = {(r.doc_id, r.item_id): r for r in rows}
    want = {}
    texts = dict(docs)
    for d, t in docs:
        if d < 500:
            for i, x in items:
                w = words(x)
                if w and (n := sellers(w, words(t))) <= int(EDITS * len(w) + 1e-9):
                    want[d, i] = n
    assert any(i == 52 for _, i in want) and any(i == 55 for _, i in want)
    want |= {(502, 53): 0, (502, 54): 0, (503, 3): 0}
    assert set(got) <= set(want), "a pair over the limit"
    assert len(got) >= 0.98 * len(want), (len(got), len(want))
    assert all(n == got[k].distance for k, n in want.items() if k in got)
    for (d, i), r in got.items():
        span, item = words(texts[d])[r.start_word : r.end_word], words(dict(items)[i])
        assert sellers(item, span) == r.distance and abs(len(span) - len(item)) <= r.distance
    assert len([r for r in rows if r.doc_id == 503]) == 2
    kept = {r.doc_id for r in clean_documents(df, bench).collect()}
    assert kept == set(texts) - {d for d, _ in got} and 500 in kept
    assert find_leaks(df, bench.limit(0)).count() == 0 and find_leaks(df.limit(0), bench).count() == 0


def test_keys_decide():
    """Windows that the bounds leave are many more than those that share a key with an item, which hold all leaks."""
    rng = random.Random(4)
    vocab = [f"v{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(vocab, k=20))) for i in range(20)]
    texts = [" ".join(rng.choices(vocab, k=300)) for _ in range(40)]
    for i in range(0, 40, 4):
        texts[i] += " " + items[i // 2][1]
    w, _, _, row = word_hashes(*text_buffers(pa.array(texts)))
    held = dc.Items(items)
    windows = sum(len(s) for _, s in held.windows(w, row))
    found = held.candidates(w, row)
    assert windows > 2000 and len(np.unique(found[:, 1])) < 0.7 * windows
    leaks = {(r, held.ids[i]) for r, i, *_ in held.verified(w, row, found)}
    assert leaks >= {(i, i // 2) for i in range(0, 40, 4)}
    held.tables = {n: [(k + np.uint64(1), i) for k, i in t] for n, t in held.tables.items()}
    assert not len(held.candidates(w, row))  # nothing is found without the keys
