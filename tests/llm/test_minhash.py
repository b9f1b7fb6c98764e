"""Near duplicates against brute force over all pairs."""

import random
import re

from tidemark.llm.components import components
from tidemark.llm.minhash import near_duplicates


def brute(rows, size, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    label = {i: i for i in sets}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            n = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                r, s = sorted((root(a), root(b)))
                label[s] = r
    return {(i, len(sets[i]), root(i), root(i) == i) for i in ids}


def made(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    texts = [None, "", "  \n", "one two", "ONE two", "é É", "a b c d", "a\tb c\x0bD", "a\xa0b c d e"]
    base = rng.choices(vocab, k=150)
    for _ in range(60):  # one group of near copies around the threshold
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        texts.append(" ".join(w))
    for _ in range(25):
        w = rng.choices(vocab, k=rng.randint(4, 80))
        texts += [" ".join(w), " ".join([*w, "tail"]), " ".join(w).upper()]
    texts += ["the same words here again"] * 30 + ["x y " * 20_000, "x y " * 20_000 + "z"]
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_against_all_pairs(spark):
    for seed, size in ((1, 4), (2, 5)):
        rows = made(seed)
        df = spark.createDataFrame([(i, t, 1, "k", 5) for i, t in rows] + [(None, "a b c d e", 1, "k", 5)], "doc_id long, text string, n int, bucket string, component_id int").repartition(4)
        got = {tuple(r) for r in near_duplicates(df, size=size).select("doc_id", "n_shingles", "component_id", "kept").collect()}
        assert got == brute(rows, size, 80) | {(None, 2 if size == 4 else 1, None, True)}


def test_repeated_ids(spark):
    """Rows of one id are one document with the least text, and come back each."""
    one, two = "a b c d e f g h i j", "b c d e f g h i j k l m n o p"
    rows = [(1, one), (2, two), (3, one), (3, two), (3, two), (4, two), (5, None), (5, "")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    got = sorted(tuple(r) for r in got.select("doc_id", "n_shingles", "component_id", "kept").collect())
    assert got == [(1, 6, 1, True), (2, 11, 2, True), *[(3, 6, 1, False)] * 3, (4, 11, 2, False), *[(5, 0, 5, True)] * 2]


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components(spark):
    rng = random.Random(3)
    path = [(i, i + 1) for i in range(100, 160)]
    star = [(5, i) for i in range(200, 260)]
    loose = [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    links = [*path, *star, *loose, (7, 7), (None, 3)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(links, "a long, b long")).collect())
    label = {}

    def root(x):
        while label.setdefault(x, x) != x:
            x = label[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            r, s = sorted((root(a), root(b)))
            label[s] = r
    assert got == {x: root(x) for x in label}
