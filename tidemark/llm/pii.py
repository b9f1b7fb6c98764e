"""Personal data: patterns with checks, and terms whose co-occurrence in the corpus gives a protected value away.

Base kinds: email, ip (parts at most 255), card (13 to 19 digits, Luhn), phone (9 to 15 digits); leftmost and
non-overlapping within a kind, failing matches dropped. A protected entity is a distinct base value, or what several
values have in common and a term may as well give away: an email's domain, an address's network (three parts), a card's
issuer (six digits), a phone's prefix (all but four digits). Its context is the WINDOW words on either side of each of
its mentions. For a term t and an entity e,

    reveal(t, e) = occurrences of t in contexts of e / all occurrences of t in the corpus      (an estimate of p(e | t))
    bits(t, e)   = log2(reveal(t, e) / (tokens in contexts of e / all tokens))                 (pointwise information)

A term discloses e when reveal >= GENERALISE, bits >= BITS and chance(t, e) <= CHANCE (GROUP_CHANCE where e is shared by
several values, as it has more contexts to be met in). For a term in k different contexts
of e and, at its reveal, in m = k / reveal contexts at all,

    chance(t, e) = bound on P(at least k - 1 of m - 1 contexts are e's | a context is e's with p = e's share of tokens)

The first context made t a candidate and shows nothing, so one passage and its copies (one context) disclose nothing;
how many more it takes follows from the counts, two contexts being enough in all but the smallest tables. An occurrence
beside several mentions of e counts once, with the first. Terms are words of any characters, digits and @ included,
other than those a base span touches. All occurrences of a disclosing term in the corpus become spans: of kind "remove"
from REMOVE on, else "generalise". sanitise() takes the former out and puts the class of the latter in its place: the
more general term is <NUMBER>, <CODE> (letters and digits), <NAME> (a capital first) or <WORD>. Counts are over all
tokens of all documents, pre-aggregated in each task.

Up to TERMS_HELD terms go to the tasks, which then find, and replace, all spans of a text in one pass, without a
shuffle; more terms meet the words of the texts in a join.

Null text: as empty. Repeated rows: one output row each. Empty table: empty result. Other columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix64, slices, small_batches, text_buffers, word_hashes, written

WINDOW, GENERALISE, REMOVE, BITS, CHANCE, GROUP_CHANCE = 8, 0.5, 0.9, 6.0, 0.01, 1e-4
TERMS_HELD = 1 << 18
KINDS = ("email", "ip", "card", "phone")
FILTER_BITS = 1 << 20

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A start inside a run of digits that its first digit could not start matches nothing either.
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """As the pattern local@domain finds them, in linear time: the local part is the run before the sign."""
    end, at = 0, text.find("@")
    while at >= 0:
        m = _DOMAIN.match(text, at + 1)
        if m and at > end and text[at - 1] in _LOCAL:
            start = at - 1
            while start > end and text[start - 1] in _LOCAL:
                start -= 1
            end = m.end()
            yield start, end
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind and start."""
    out = [("email", s, e) for s, e in emails(text)]
    if _DIGIT.search(text) is None:
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and _luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGIT.findall(m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


def _entities(kind: str, found: str) -> tuple[str, str]:
    """The value, and what it shares with others."""
    if kind == "email":
        return "email:" + found.lower(), "domain:" + found.lower().rpartition("@")[2]
    if kind == "ip":
        return "ip:" + found, "network:" + found.rpartition(".")[0]
    digits = re.sub("[^0-9]", "", found)
    return f"{kind}:{digits}", "issuer:" + digits[:6] if kind == "card" else "prefix:" + digits[:-4]


def _number(entity: str, shared: bool) -> int:
    """64-bit hash; odd for what several values share."""
    h = int.from_bytes(hashlib.blake2b(entity.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)
    return h | 1 if shared else h & ~1


def _beside(text: str, s: int, e: int) -> list[tuple[int, int]]:
    """Where the WINDOW words on either side of a span stand."""
    reach = 40
    while True:
        a, b = max(0, s - reach * WINDOW), min(len(text), e + reach * WINDOW)
        left, right = ([m.span() for m in _WORD.finditer(text, i, j)] for i, j in ((a, s), (e, b)))
        left = left[1:] if a and left and left[0][0] == a else left  # may be the rest of a word
        right = right[:-1] if b < len(text) and right and right[-1][1] == b else right
        if (a == 0 or len(left) > WINDOW) and (b == len(text) or len(right) > WINDOW):
            break
        reach *= 4
    # A word joined to the span (a bracket, say) is part of it.
    left = left[:-1] if left and left[-1][1] == s else left
    right = right[1:] if right and right[0][0] == e else right
    return left[-WINDOW:] + right[:WINDOW]


BASE = "doc_id long, text_hash long, base string, n_email long, n_ip long, n_card long, n_phone long"


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [base_spans(t or "") for t in b.column(2).to_pylist()]
        counts = [pa.array([sum(k == kind for k, _, _ in f) for f in found], pa.int64()) for kind in KINDS]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([",".join(f"{k}:{s}:{e}" for k, s, e in f) for f in found], pa.string()), *counts], [x.split()[0] for x in BASE.split(", ")])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        entity, around, fresh = [], [], []
        for t in b.column(2).to_pylist():
            spans = sorted((s, e, k) for k, s, e in base_spans(t or ""))
            starts, reach = [s for s, _, _ in spans], np.maximum.accumulate([e for _, e, _ in spans]) if spans else []
            counted = set()
            for s, e, k in spans:
                beside = []
                for i, j in _beside(t, s, e):
                    before = bisect.bisect_left(starts, j)
                    if not before or reach[before - 1] <= i:  # touches no base span
                        beside.append((i, j))
                for shared, named in enumerate(_entities(k, t[s:e])):
                    one = _number(named, bool(shared))
                    fresh += [(one, i) not in counted for i, _ in beside]
                    counted |= {(one, i) for i, _ in beside}
                    entity.append(one)
                    around.append(" ".join(t[i:j] for i, j in beside))
        words, _, _, row = word_hashes(*text_buffers(pa.array(around, pa.string())))
        if len(words):
            place = (np.arange(len(words)) - np.searchsorted(row, row)).astype(np.uint64)
            context = np.zeros(len(around), np.uint64)
            np.add.at(context, row, mix64(words + place * np.uint64(0x9E3779B97F4A7C15)))
            at = np.flatnonzero(fresh)
            row = row[at]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(entity)[row]), pa.array(words[at].view(np.int64)), pa.array(context[row].view(np.int64))], ["entity", "term", "context"])


def _slices(b: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    raw, at = text_buffers(b.column(column))
    for i, j in slices(at):
        yield i, j, raw[at[i] : at[j]], at[i : j + 1] - at[i]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        words, n = np.unique(word_hashes(*text_buffers(b.column(0)))[0], return_counts=True)
        if len(words):
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], ["term", "n"])


def _chance(hits: Column, tries: Column, p: Column) -> Column:
    """Chernoff's bound on at least ``hits`` of ``tries`` at probability p; exact where all hit."""
    share = hits / tries
    missed = F.when(share < 1, (1 - share) * F.ln((1 - share) / (1 - p))).otherwise(0.0)
    return F.when(share > p, F.exp(-tries * (share * F.ln(share / p) + missed))).otherwise(1.0)


def disclosing_terms(texts: DataFrame) -> DataFrame:
    """(term hash, kind) of terms that disclose an entity; texts has doc_id, text_hash, text."""
    seen = texts.mapInArrow(_contexts, "entity long, term long, context long")
    seen = seen.groupBy("entity", "term", "context").agg(F.count("*").alias("n")).groupBy("entity", "term").agg(F.sum("n").alias("n"), F.count("*").alias("contexts"))
    seen = written(seen, "contexts")
    entities = seen.groupBy("entity").agg(F.sum("n").alias("n_entity"))
    # One context is left to chance whatever the counts.
    pairs = seen.where("contexts > 1").withColumnRenamed("n", "n_pair").join(entities, "entity")
    counts = texts.select("text").mapInArrow(_counts, "term long, n long").groupBy("term").agg(F.sum("n").alias("n_term"))
    counts = written(counts, "term-counts")
    total = (counts.agg(F.sum("n_term")).first()[0] or 0) + 0.0
    reveal = F.least(F.lit(1.0), F.col("n_pair") / F.col("n_term"))
    pairs = pairs.join(counts, "term").withColumn("reveal", reveal).withColumn("bits", F.log2(F.col("reveal") * F.lit(total) / F.col("n_entity")))
    pairs = pairs.withColumn("chance", _chance(F.col("contexts") - 1, F.col("contexts") / F.col("reveal") - 1, F.col("n_entity") / F.lit(total)))
    limit = F.when(F.col("entity") % 2 == 0, CHANCE).otherwise(GROUP_CHANCE)
    found = pairs.where((F.col("reveal") >= GENERALISE) & (F.col("bits") >= BITS) & (F.col("chance") <= limit)).groupBy("term").agg(F.max("reveal").alias("reveal"))
    return found.select("term", F.when(F.col("reveal") >= REMOVE, "remove").otherwise("generalise").alias("kind"))


def _occurrences(held: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, _, raw, at in _slices(b, 2):
                words, start, end, row = word_hashes(raw, at)
                hit = np.flatnonzero(held[(words & np.uint64(FILTER_BITS - 1)).astype(np.int64)])
                if len(hit):
                    point = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
                    base = point[at[:-1]][row[hit]]
                    take = pa.array(row[hit] + i)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(words[hit].view(np.int64)), pa.array(point[start[hit]] - base), pa.array(point[end[hit]] - base)], ["doc_id", "text_hash", "term", "start", "stop"])

    return run


def _term_spans(text: pa.Array, terms: np.ndarray, removed: np.ndarray, held: np.ndarray) -> dict[int, list[tuple[str, int, int]]]:
    """Row to the spans of terms (sorted hashes) in it; held is their filter."""
    out: dict[int, list[tuple[str, int, int]]] = {}
    raw, offsets = text_buffers(text)
    for i, j in slices(offsets):
        part, at = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        words, start, end, row = word_hashes(part, at)
        hit = np.flatnonzero(held[(words & np.uint64(FILTER_BITS - 1)).astype(np.int64)])
        if len(hit):
            near = np.minimum(np.searchsorted(terms, words[hit]), len(terms) - 1)
            found = terms[near] == words[hit]
            hit, near = hit[found], near[found]
        if len(hit):
            point = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])
            base = point[at[:-1]][row[hit]]
            for r, gone, s, e in zip((row[hit] + i).tolist(), removed[near].tolist(), (point[start[hit]] - base).tolist(), (point[end[hit]] - base).tolist(), strict=True):
                out.setdefault(r, []).append(("remove" if gone else "generalise", s, e))
    return out


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


class _Held:
    """Terms that go to the tasks."""

    def __init__(self, rows: list):
        pairs = sorted((r[0] & (1 << 64) - 1, r[1] == "remove") for r in rows)
        self.terms, self.removed = np.array([p[0] for p in pairs], np.uint64), np.array([p[1] for p in pairs], bool)
        self.filter = np.zeros(FILTER_BITS, bool)
        self.filter[(self.terms & np.uint64(FILTER_BITS - 1)).astype(np.int64)] = True

    def spans(self, text: pa.Array) -> Iterator[tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]]:
        """(base, terms') spans of every text."""
        added = _term_spans(text, self.terms, self.removed, self.filter) if len(self.terms) else {}
        for i, t in enumerate(text.to_pylist()):
            yield base_spans(t or ""), sorted(added.get(i, ()))


def _terms_of(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, _Held | None]:
    """(texts, terms, the terms for the tasks or None if they are too many)."""
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    terms = written(disclosing_terms(texts), "terms")
    few = terms.count() <= TERMS_HELD
    return texts, terms, _Held(terms.collect()) if few else None


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base (kind:start:end, comma-joined), spans (the same with terms'),
    text_hash (xxhash64 of the text). Eager up to the table of terms."""
    texts, terms, held = _terms_of(docs, id_col, text_col)
    if held is not None:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = list(held.spans(b.column(2)))
                counts = [pa.array([sum(k == kind for k, _, _ in f) for f, _ in found], pa.int64()) for kind in KINDS]
                lists = [pa.array(x, pa.string()) for x in ([_joined(f) for f, _ in found], [_joined(f + g) for f, g in found])]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists[0], *counts, lists[1]], [x.split()[0] for x in (BASE + ", spans string").split(", ")])

        return texts.mapInArrow(run, BASE + ", spans string")
    base = texts.mapInArrow(_find, BASE)
    # At most FILTER_BITS numbers, whatever the number of terms; a fuller filter only passes more words to the join.
    filled = np.zeros(FILTER_BITS, bool)
    filled[[r[0] for r in terms.select(F.col("term").bitwiseAND(FILTER_BITS - 1)).distinct().collect()]] = True
    spans = texts.mapInArrow(_occurrences(filled), "doc_id long, text_hash long, term long, start long, stop long").distinct().join(terms, "term")
    spans = spans.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list(F.struct("kind", "start", "stop"))).alias("terms"))
    added = F.array_join(F.transform("terms", lambda x: F.concat_ws(":", x.kind, x.start, x.stop)), ",")
    out = base.join(spans.withColumnRenamed("doc_id", "d").withColumnRenamed("text_hash", "h"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left")
    return out.withColumn("spans", F.concat_ws(",", F.nullif(F.col("base"), F.lit("")), added)).drop("d", "h", "terms")


def _general(word: str) -> str:
    if not re.search("[0-9]", word):
        return "<NAME>" if word[:1].isupper() else "<WORD>"
    return "<CODE>" if re.search(r"[^\W\d_]", word) else "<NUMBER>"


def replaced(text: str, spans: list[tuple[str, int, int]]) -> str:
    """text with every span replaced; overlapping spans are one, named after the first."""
    out, at = [], 0
    for s, e, k in sorted((s, e, k) for k, s, e in spans):
        if s >= at:
            mark = "" if k == "remove" else _general(text[s:e]) if k == "generalise" else f"<{k.upper()}>"
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the text's spans replaced by <KIND>, by the class of the word for kind "generalise", or taken out for
    kind "remove". Null texts stay null. All columns of docs are kept."""
    _, _, held = _terms_of(docs, id_col, text_col)
    place, schema = docs.columns.index(text_col), docs.schema
    if held is None:
        spans = find_pii(docs, id_col, text_col).where("spans <> ''").select(F.col("doc_id").alias("__d"), F.col("text_hash").alias("__h"), F.col("spans").alias("__spans")).distinct()
        docs = docs.join(spans, F.col(id_col).cast("long").eqNullSafe(F.col("__d")) & (F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) == F.col("__h")), "left").drop("__d", "__h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, columns = b.column(place).to_pylist(), list(b.columns[: len(schema)])
            if held is not None:
                spans = (f + g for f, g in held.spans(b.column(place)))
            else:
                spans = ([(k, int(s), int(e)) for k, s, e in (x.split(":") for x in (j or "").split(",") if x)] for j in b.column(len(schema)).to_pylist())
            columns[place] = pa.array([t if t is None or not f else replaced(t, f) for t, f in zip(texts, spans, strict=True)], b.column(place).type)
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return docs.mapInArrow(run, schema)
