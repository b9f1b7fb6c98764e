"""Base spans against the plain patterns; disclosure on a made corpus with known counts."""

import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import pii
from tidemark.llm.pii import base_spans, find_pii, replaced, sanitise

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = []
    for kind, p in PLAIN.items():
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            if kind == "card":
                total = sum(sum(map(int, str(int(d) * (1 + i % 2)))) for i, d in enumerate(reversed(digits)))
                if not 13 <= len(digits) <= 19 or total % 10:
                    continue
            out.append((kind, *m.span()))
    return out


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="a.B@-+ 0123459()é,\n_%", max_size=60))
def test_base_spans(text):
    assert base_spans(text) == plain(text)


def test_examples():
    text = "é a.b+c@x-y.co.uk, 1.2.3.4.5.6.7.8 256.1.1.1 +1 (743) 555-3824; 4381893557741609; 4381-8935-5774-1609 a@b@c.d x@y.z@q.r"
    assert base_spans(text) == plain(text) and [k for k, _, _ in base_spans(text)] == ["email"] * 3 + ["ip"] * 2 + ["card"] * 2 + ["phone"]
    long = "x" * 300_000 + "@" + "9" * 300_000
    assert base_spans(long) == [] and base_spans("") == []


def corpus():
    rng = random.Random(4)
    vocab = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    say = lambda n: " ".join(rng.choices(vocab, k=n))
    rows = [(i, say(60)) for i in range(300)]
    rows += [(300 + i, f"{say(20)} zorblatt jane@site.example.com {say(20)}") for i in range(6)]  # discloses: always beside jane
    rows += [(310 + i, f"é{say(20)} qumquat +1 (743) 555-3824 {say(20)}") for i in range(6)] + [(320 + i, f"{say(9)} Qumquat {say(3)}") for i in range(2)]
    rows += [(330 + i, "one copied text onlyhere ann@site.example.com as it is") for i in range(8)]  # one context
    rows += [(400, None), (401, ""), (402, "word " * 50_000), (300, rows[300][1])]
    return rows


def test_disclosure(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, start int, spans string").repartition(5)
    got = find_pii(df).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        t = texts[r.doc_id] or ""
        want = base_spans(t)
        assert r.base == ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for k, _, _ in want) for x in ("email", "ip", "card", "phone"))
        added = [(m.start(), m.end()) for m in re.finditer(r"zorblatt|[qQ]umquat", t)]
        kind = "remove" if "zorblatt" in t else "generalise"
        assert r.spans == ",".join(filter(None, [r.base, *(f"{kind}:{s}:{e}" for s, e in added)])), t
    clean = {r.doc_id: r for r in sanitise(df).collect()}
    assert clean[400].text is None and clean[402].text == texts[402] and clean[0].text == texts[0] and clean[0].start == 1
    assert clean[305].text == texts[305].replace("zorblatt", "").replace("jane@site.example.com", "<EMAIL>")
    assert clean[311].text == texts[311].replace("qumquat", "<WORD>").replace("+1 (743) 555-3824", "<PHONE>")
    assert sanitise(df).count() == len(rows)
    assert find_pii(df.limit(0)).count() == 0


def test_few_mentions(spark):
    """Two mentions in different passages are enough, and words with digits are terms; one passage and its copies are not."""
    rng = random.Random(5)
    say = lambda n: " ".join(rng.choices([f"v{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)], k=n))
    rows = [(i, say(60)) for i in range(200)]
    rows += [(300 + i, f"{say(12)} acct-4471 bob@site.example.com floriel {say(12)}") for i in range(2)]
    rows += [(310 + i, f"{say(12)} user@17 +1 (743) 555-3824 {say(12)}") for i in range(3)] + [(320, f"{say(9)} user@17 {say(3)}")]
    rows += [(330, f"{say(12)} seenonce 10.1.2.3 {say(12)}")]
    rows += [(340, f"{say(12)} 10.1.2.4 between 10.1.2.4 {say(12)}")]  # one occurrence in two contexts
    rows += [(350 + i, f"{say(12)} 10.1.2.5 10.1.2.6 {say(12)}") for i in range(2)]  # base spans are no terms
    rows += [(360 + i, "never moved qx77 ann@site.example.com from its place") for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    texts = dict(rows)
    for r in find_pii(df).collect():
        t = texts[r.doc_id]
        added = [(m[0], m.start(), m.end()) for m in re.finditer(r"acct-4471|floriel|user@17", t)]
        want = sorted(("generalise" if w == "user@17" else "remove", s, e) for w, s, e in added)
        assert r.spans == ",".join(filter(None, [r.base, *(f"{k}:{s}:{e}" for k, s, e in want)])), t


def brute_terms(rows):
    """The disclosure rule over plain Python counts: term to kind."""
    import math
    from collections import Counter, defaultdict

    total, pairs, contexts, entity_tokens = Counter(), defaultdict(set), defaultdict(set), Counter()
    for i, (_, t) in enumerate(rows):
        t = t or ""
        words = [(m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", t)]
        total.update(t[s:e].lower() for s, e in words)
        spans = base_spans(t)
        for k, s, e in spans:
            left, right = [w for w in words if w[1] < s or w[1] == s and False], [w for w in words if w[0] > e]
            around = [w for w in left[-8:] + right[:8] if not any(a < w[1] and w[0] < z for _, a, z in spans)]
            for name in pii._entities(k, t[s:e]):
                for w in around:
                    pairs[name, t[w[0] : w[1]].lower()].add((i, w[0]))
                    contexts[name, t[w[0] : w[1]].lower()].add(" ".join(t[a:z].lower() for a, z in around))
    for (name, _), at in pairs.items():
        entity_tokens[name] += len(at)
    n, out = sum(total.values()), {}
    for (name, term), at in pairs.items():
        k, reveal, p = len(contexts[name, term]), min(1.0, len(at) / total[term]), entity_tokens[name] / n
        if k < 2 or reveal < pii.GENERALISE or math.log2(reveal / p) < pii.BITS:
            continue
        hits, tries = k - 1, k / reveal - 1
        share = hits / tries
        missed = (1 - share) * math.log((1 - share) / (1 - p)) if share < 1 else 0.0
        chance = math.exp(-tries * (share * math.log(share / p) + missed)) if share > p else 1.0
        shared = name.split(":")[0] in ("domain", "network", "issuer", "prefix")
        if chance <= (pii.GROUP_CHANCE if shared else pii.CHANCE):
            out[term] = max(out.get(term, 0), reveal)
    return {t: "remove" if r >= pii.REMOVE else "generalise" for t, r in out.items()}


def test_rule_against_brute_force(spark, monkeypatch):
    """All spans, where terms are tied to single values and to what several values share; in one pass and by the join."""
    rng = random.Random(8)
    say = lambda n: " ".join(rng.choices([f"v{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)], k=n))
    rows = [(i, say(80)) for i in range(400)] + [(900, None), (901, "")]
    rows += [(500 + i, f"{say(15)} helpdesk-{i % 3} user{i}@corp.example.com {say(15)}") for i in range(12)]
    rows += [(520 + i, f"{say(15)} Labrack 10.20.30.{i} {say(15)}") for i in range(9)] + [(530 + i, f"{say(15)} Labrack {say(15)}") for i in range(3)]
    rows += [(540 + i, f"{say(15)} 77123 +44 207 946 0{i}12 {say(15)}") for i in range(4)] + [(550, f"{say(9)} 77123 {say(2)}")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    terms = brute_terms(rows)
    assert {"helpdesk-0", "labrack", "77123"} <= set(terms) and terms["labrack"] == "generalise"
    texts = dict(rows)

    def want(t):
        base = base_spans(t)
        return base + sorted((terms[m[0].lower()], m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", t) if m[0].lower() in terms)

    for held in (pii.TERMS_HELD, 0):
        monkeypatch.setattr(pii, "TERMS_HELD", held)
        for r in find_pii(df).collect():
            assert r.spans == ",".join(f"{k}:{s}:{e}" for k, s, e in want(texts[r.doc_id] or "")), (held, r)
        for r in sanitise(df).collect():
            t = texts[r.doc_id]
            assert r.text == (t if t is None else replaced(t, want(t)))
    assert "<NAME>" in replaced(texts[520], want(texts[520])) and "<NUMBER>" in replaced(texts[540], want(texts[540]))
