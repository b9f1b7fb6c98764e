"""Main text on made pages with known articles, and the suffix array against sorting."""

import random
import re

import numpy as np
import pytest

from tidemark.llm import html_text
from tidemark.llm.html_text import ARTICLE, GUARDED, UNDECIDED, blocks_of, main_text, shared_prefixes, suffix_array


def text_of(html):
    return "\n".join(t for t, z in blocks_of(html) if z == ARTICLE)


def test_markup():
    page = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t="</p>";</script></head><body>
      <nav><ul><li><a href="/x">menu</a></li></ul></nav><!-- <p>gone</p> --><div class="ad">Buy <b>now</b></div>
      <article><header><h1>Head  line &amp; more</h1></header><p><b>Open bold.<br><p>Two&nbsp; words &lt;b&gt; caf&eacute; &#8364;
      <p>A < B and <em>mid</em>dle<ul><li>one<li>two</ul><aside>side</aside><div id="comments"><p>reader</p></div><p>end</article>
      <form><input value="x">go</form><footer>&copy; x</footer></body></html>"""
    assert text_of(page) == "Head line & more\nOpen bold.\nTwo words <b> café €\nA < B and middle\none\ntwo\nend"
    assert {t for t, z in blocks_of(page) if z == UNDECIDED} == set()
    assert [t for t, z in blocks_of(page) if z == GUARDED] == ["menu", "Buy now", "side", "reader", "go", "© x"]
    assert text_of("<main><p>a</p></main><p>b") == "a" and blocks_of("plain <b>text") == [("plain text", UNDECIDED)]
    assert blocks_of("") == [] and blocks_of("<p>a<script>never ends") == [("a", UNDECIDED)]
    assert text_of("<article>x" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "y</article>") == "x\ndeep\ny"


def test_suffix_array():
    rng = random.Random(1)
    for n in (1, 2, 7, 60):
        t = np.array([rng.randrange(3) for _ in range(n)])
        assert suffix_array(t).tolist() == sorted(range(n), key=lambda i: t[i:].tolist())
    t, s = np.array([1, 2, 3, 9, 1, 2, 3, 1, 2]), np.array([0, 0, 0, 0, 1, 1, 1, 1, 1])
    order, number = shared_prefixes(t, s, 3)
    assert sorted(sorted(order[number == k].tolist()) for k in set(number)) == [[0, 4], [1], [5], [6]]


@pytest.mark.parametrize("runs", [html_text.RUNS, 0])
def test_host_boilerplate(spark, monkeypatch, runs):
    monkeypatch.setattr(html_text, "RUNS", runs)
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    notice, rows, want = "this site uses small files to keep your settings for next time", [], {}
    for i in range(40):
        own = " ".join(word() for _ in range(30))
        rows.append((i, f"https://a.example.com/{i}?q=1", f"<body><div>{notice}</div><div>{own}</div><div>end{i} {notice}</div>", 1, "h"))
        want[i] = f"{own}\nend{i}"
    rows += [(100, "http://b.example.com/", f"<p>{notice}</p>", 1, "h"), (101, None, None, 1, "h"), (102, "", "", 1, "h")]
    rows += [(103, "https://c.example.com/1", f"<div>{want[0]} same</div>", 1, "h")] * 2
    want |= {100: notice, 101: "", 102: "", 103: want[0].replace("\n", " ") + " same"}
    df = spark.createDataFrame(rows, "page_id long, url string, html string, row_id int, host string").repartition(5)
    got = main_text(df).collect()
    assert len(got) == len(rows) and {r.page_id: r.text for r in got} == want
    assert all(r.n_chars == len(r.text) for r in got)
    assert main_text(df.limit(0)).count() == 0


def test_near_copies_and_quotes_stay(spark):
    """Of pages without an article, only what a share of the host's pages has is boilerplate, and in blocks made of it."""
    rng = random.Random(3)
    say = lambda n: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n))
    notice, body, rows, want = "this site uses small files to keep your settings for next time", say(80), [], {}
    for i in range(30):
        own = f"{body} version{i}" if i < 2 else f"{say(20)} {' '.join(body.split()[10:30])} {say(20)}" if i == 2 else say(40)
        own = f"{say(20)} {notice} {say(20)}" if i == 3 else own
        rows.append((i, "https://a.example.com/", f"<div>{notice}</div><div>{own}</div>"))
        want[i] = own
    for i in range(2):  # a host of two near copies
        rows.append((100 + i, "https://b.example.com/", f"<div>{body} edition{i}</div>"))
        want[100 + i] = f"{body} edition{i}"
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    assert {r.page_id: r.text for r in main_text(df).collect()} == want


@pytest.mark.parametrize("runs", [html_text.RUNS, 0])
def test_the_array_decides(spark, monkeypatch, runs):
    """Blocks without a mark beside articles go where they repeat on some pages of the host, not where they are a page's
    own; without the array they would stay. Marked blocks that repeat are counted as the array's."""
    monkeypatch.setattr(html_text, "RUNS", runs)
    rng = random.Random(6)
    say = lambda n: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n))
    adverts, quote, rows, want = [say(12) for _ in range(10)], say(20), [], {}
    for i in range(60):
        body, own = f"{say(30)} {quote} {say(5)}", say(9)
        rows.append((i, "https://a.example.com/", f"<nav>{say(3)}</nav><div>{adverts[i % 10]}</div><article>{body}</article><div>{own}</div><footer>{adverts[(i + 3) % 10]}</footer>"))
        want[i] = f"{body}\n{own}"
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = {r.page_id: r for r in main_text(df).collect()}
    assert {i: r.text for i, r in got.items()} == want
    assert all((r.n_repeated, r.n_guarded) == (2, 1) for r in got.values())

    def nothing(size):
        def run(batches):
            for _ in batches:
                yield from ()

        return run

    monkeypatch.setattr(html_text, "_intervals", nothing)
    assert all(r.text == f"{adverts[r.page_id % 10]}\n{want[r.page_id]}" for r in main_text(df).collect())


def plain(pages):
    """The rule by sets of all runs of words: (page_id, url, html) to page_id: (text, n_repeated, n_guarded)."""
    import math

    words = lambda t: [w for w in re.split("[\x20\x09-\x0d]+", t) if w]
    low = lambda w: w.translate({c: c + 32 for c in range(65, 91)})
    parsed = [(i, "" if u is None else u.split("/")[2], blocks_of(h or "")) for i, u, h in pages]
    streams, runs = {}, {}
    for _, host, blocks in parsed:
        beside = [low(w) for t, z in blocks if z != ARTICLE for w in words(t)]
        key = tuple(low(w) for t, _ in blocks for w in words(t))
        if beside and key not in streams.setdefault(host, set()):
            streams[host].add(key)
            for run in {tuple(beside[k : k + 8]) for k in range(len(beside) - 7)}:
                runs[host, run] = runs.get((host, run), 0) + 1
    out = {}
    for i, host, blocks in parsed:
        beside = [low(w) for t, z in blocks if z != ARTICLE for w in words(t)]
        covered, often = set(), set()
        for k in range(len(beside) - 7):
            n = runs.get((host, tuple(beside[k : k + 8])), 0)
            if n >= 3:
                covered |= set(range(k, k + 8))
            if n >= max(3, math.ceil(len(streams[host]) * 0.3)):
                often |= set(range(k, k + 8))
        if all(z != ARTICLE for _, z in blocks) and len(covered) > 0.8 * len(beside):
            covered = often
        kept, at, repeated, guarded = [], 0, 0, 0
        for t, z in blocks:
            if z != ARTICLE:
                mine = words(t)
                left = [w for k, w in enumerate(mine) if at + k not in covered]
                at += len(mine)
                gone = 2 * len(left) < len(mine)
                repeated, guarded = repeated + gone, guarded + (z == GUARDED and not gone)
                t = "" if z == GUARDED else " ".join(left if gone else mine)
            if t:
                kept.append(t)
        out[i] = ("\n".join(kept), repeated, guarded)
    return out


@pytest.mark.parametrize("runs", [html_text.RUNS, 0])
@pytest.mark.parametrize("seed", range(3))
def test_whole_result_against_sets_of_runs(spark, monkeypatch, seed, runs):
    """Hosts of pages with and without articles, shared and rare boilerplate, near copies, quotes and copies."""
    monkeypatch.setattr(html_text, "RUNS", runs)
    rng = random.Random(seed)
    say = lambda n: " ".join("".join(rng.choices("abcdefgh", k=4)) for _ in range(n))
    pages = []
    for host in range(4):
        shared = [say(rng.randint(3, 25)) for _ in range(6)]
        bodies = [say(60) for _ in range(8)]
        for k in range(12):
            body = rng.choice(bodies) + " " + say(rng.choice([0, 3, 40]))
            tag = rng.choice(["article", "div", "section"])
            around = [rng.choice(shared) for _ in range(4)] + [say(rng.randint(1, 15))]
            rng.shuffle(around)
            marks = [rng.choice(["<div>{}</div>", "<nav>{}</nav>", "<p class='ad'>{}</p>", "<p>{}</p>"]).format(t.title() if rng.random() < 0.2 else t) for t in around]
            pages.append((100 * host + k, f"https://h{host}.example.com/{k}", f"<body>{marks[0]}{marks[1]}<{tag}>{body}</{tag}>{''.join(marks[2:])}"))
        pages.append((100 * host + 50, pages[-1][1], pages[-1][2]))
    pages += [(900, None, None), (901, "https://h0.example.com/", "")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: (r.text, r.n_repeated, r.n_guarded) for r in main_text(df).collect()}
    assert got == plain(pages) and sum(x[1] for x in got.values()) > 20
