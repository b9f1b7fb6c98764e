"""Main text of web pages: a suffix array over each host's pages finds what repeats, markup guards the rest.

Every page is cut into blocks in page order. Markup puts a block into one of three zones: guarded (inside nav, footer,
aside, form, a page header, or an element whose class or id names an advert, menu, notice, sidebar, comment list and the
like), article (inside <article>, or <main> where the page has no article), or undecided. The token streams of all
blocks outside of articles go through the host suffix array: suffixes sorted, long common prefixes between pages found.
A run of at least ``min_tokens`` that stands in PAGES of the host's different streams is repeated. A block mostly made
of repeated runs is boilerplate and loses them, and keeps its own words; any other undecided block stays whole. Text
inside an article is never looked at: what repeats there is a quotation or a copy. On pages without an article the text
may be in any block; there, if more than COPY of the page's words would go, the page is a near copy of others, and what
tells boilerplate from text is how often it repeats: a run must stand in SHARE of the host's different streams, too.
Guarded blocks that do not repeat (a menu of its own page) go by their markup; the counts of blocks that went either way
are returned. Pages whose texts are equal, articles included, count as one, so a copied page does not erase itself.

A host can hold a third of all pages, so no host is gathered. Tasks build suffix arrays over their own pages and hand
on, for each interval of suffixes with a common prefix of min_tokens, one row (host, prefix, streams it stands in), one
page a stream taking part; these meet in a pre-aggregated groupBy. Up to RUNS repeated prefixes go to the tasks, which
look their pages' places up and write the texts without a shuffle; more of them meet the pages' places in a join. Texts and
counts are the same on either way.

Null or empty html: empty text. Repeated rows: one output row each. Null url: its own host. Empty table: empty result.
Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, small_batches, text_buffers, word_hashes, written

MIN_TOKENS, SHARE, COPY, PAGES, RUNS = 8, 0.3, 0.8, 3, 1 << 20
GUARDED, UNDECIDED, ARTICLE = 0, 1, 2

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S)
_ATTRIBUTE = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_RAW = {"script", "style", "title", "textarea", "xmp", "noembed", "noframes", "iframe", "noscript", "svg", "math", "template", "object", "canvas", "audio", "video", "select"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_SKIP = {"nav", "footer", "aside", "form", "button", "dialog", "menu", "head"}
_INLINE = {"a", "abbr", "b", "bdi", "bdo", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strong", "sub", "sup", "time", "tt", "u", "var"}
_HINT = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|banner|sponsor(?:ed)?|promo(?:tion)?|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|sidebar|nav|navbar|navigation|"
    r"menu|breadcrumbs?|footer|masthead|topbar|comments?|replies|disqus|respond|share|sharing|social|related|recommended|newsletter|subscribe|subscription|signup|login|pagination|pager|toolbar|"
    r"widget|copyright|disclaimer|skip|search|complementary|contentinfo)(?:$|[\s_-])",
    re.I,
)
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_END_RAW = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in _RAW}


def blocks_of(html: str) -> list[tuple[str, int]]:
    """(text, zone) of every block with text, in page order."""
    out: list[list] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # tag, skipped, within article, within main
    parts: list[str] = []

    def close_block() -> None:
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            parts.clear()
            if text:
                _, skipped, article, main = stack[-1] if stack else ("", False, False, False)
                out.append([text, GUARDED if skipped else ARTICLE if article else UNDECIDED, main and not skipped])

    at, n, articles = 0, len(html), False
    while at < n:
        m = _MARKUP.search(html, at)
        if m is None:
            parts.append(html[at:])
            break
        if m.start() > at:
            parts.append(html[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag not in _INLINE:
                close_block()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    if tag not in _INLINE:
                        del stack[i:]
                    elif i == len(stack) - 1:
                        stack.pop()
                    break
                if tag in _INLINE and stack[i][0] not in _INLINE or stack[i][0] == "article" and tag in ("p", "li"):
                    break
            continue
        if tag in _RAW:
            end = None if m[3].endswith("/") else _END_RAW[tag].search(html, at)
            if not m[3].endswith("/"):
                at = end.end() if end else n
            continue
        if tag in _VOID:
            if tag == "hr":
                close_block()
            else:
                parts.append(" ")
            continue
        if tag not in _INLINE:
            close_block()
            if stack and tag != "body":  # an open paragraph, or item before an item, ends here
                ends = {"p", "li", "dt", "dd", "option", "tr", "td", "th"} & ({"p", tag} if tag in ("li", "dt", "dd", "tr", "td", "th", "option") else {"p"})
                i = len(stack) - 1
                while i >= 0 and (stack[i][0] in _INLINE or stack[i][0] in ends):
                    if stack[i][0] in ends:
                        del stack[i:]
                    i -= 1
            if tag == "body":
                del stack[:]
        _, skipped, article, main = stack[-1] if stack else ("", False, False, False)
        if not skipped:
            if tag in _SKIP or tag == "header" and not article:
                skipped = True
            elif m[3] and tag not in ("body", "html", "main"):
                skipped = any(_HINT.search(next(filter(None, a), "")) for a in _ATTRIBUTE.findall(m[3]))
        if tag == "article" and not skipped:
            article = articles = True
        if m[3].endswith("/") and tag in _INLINE:
            continue
        stack.append((tag, skipped, article, main or tag == "main"))
    close_block()
    return [(t, ARTICLE if z == UNDECIDED and main and not articles else z) for t, z, main in out]


def suffix_array(tokens: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Order of the suffixes of a sequence, by prefix doubling; by their first ``depth`` tokens at least, if given."""
    n = len(tokens)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    order, k = np.argsort(rank, kind="stable"), 1
    while k < min(n, depth or n):
        second = np.full(n, -1, np.int64)
        second[:-k] = rank[k:]
        order = np.argsort(rank * (n + 1) + second, kind="stable")
        step = (np.diff(rank[order]) != 0) | (np.diff(second[order]) != 0)
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(step)])
        rank, k = new, 2 * k
        if rank[order[-1]] == n - 1:
            break
    return order


def shared_prefixes(tokens: np.ndarray, stream: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Intervals of the suffix array whose suffixes have a common prefix of ``size`` tokens: (places in their order, the
    number of each one's interval). No run goes over a stream's end."""
    order = suffix_array(tokens, size)
    room = np.zeros(len(tokens), bool)
    if len(tokens) >= size:
        room[: len(tokens) - size + 1] = stream[: len(tokens) - size + 1] == stream[size - 1 :]
    order = order[room[order]]
    if not len(order):
        return order, order
    same = np.ones(len(order) - 1, bool)  # neighbours with a common prefix of size tokens
    for k in range(size):
        same &= tokens[order[1:] + k] == tokens[order[:-1] + k]
    return order, np.concatenate([[0], np.cumsum(~same)])


PARSED = "row_id long, page_id long, url string, host string, texts array<string>, zones array<int>, beside string, stream long"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    at = TaskContext.get().partitionId() << 40
    for b in batches:
        n = b.num_rows
        found = [blocks_of(h or "") for h in b.column(2).to_pylist()]
        hosts = [re.sub(r"^[a-z][a-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*).*", r"\1", (u or "").strip().lower(), flags=re.S) for u in b.column(1).to_pylist()]
        raw = pa.array(["\n".join(t for t, _ in f) for f in found], pa.string())
        words, _, _, row = word_hashes(*text_buffers(raw))
        place = np.arange(len(words)) - np.searchsorted(row, row)
        stream = np.zeros(n, np.uint64)
        np.add.at(stream, row, mix64(words + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(at, at + n), pa.int64()), b.column(0), b.column(1), pa.array(hosts, pa.string()), pa.array([[t for t, _ in f] for f in found], pa.list_(pa.string())), pa.array([[z for _, z in f] for f in found], pa.list_(pa.int32())),
             pa.array(["\n".join(t for t, z in f if z != ARTICLE) for f in found], pa.string()), pa.array(stream.view(np.int64))],
            [x.split()[0] for x in PARSED.split(", ")],
        )
        at += n


def _streams(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Tokens outside of articles, and the row of each."""
    words, _, _, row = word_hashes(*text_buffers(b.column("beside")))
    return words, row


def _prefix_hash(words: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    h = np.zeros(len(at), np.uint64)
    for k in range(size):
        h = mix64(h * np.uint64(0x2545F4914F6CDD1D) + words[at + k])
    return h.view(np.int64)


def _intervals(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, row = _streams(b)
            # One array for all hosts of the batch: a token is a host's own.
            order, interval = shared_prefixes(mix64(words ^ _host_hash(b.column("host"))[row]), row, size)
            if len(order):
                pairs = np.unique(interval * (b.num_rows + 1) + row[order])  # streams of each interval
                first = order[np.searchsorted(interval, np.arange(interval[-1] + 1))]
                n = np.bincount(pairs // (b.num_rows + 1))
                yield pa.RecordBatch.from_arrays([b.column("host").take(pa.array(row[first])), pa.array(_prefix_hash(words, first, size)), pa.array(n)], ["host", "prefix", "n"])

    return run


def _places(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, row = _streams(b)
            at = np.flatnonzero(row[: len(row) - size + 1] == row[size - 1 :]) if len(row) >= size else np.zeros(0, np.int64)
            if len(at):
                place = np.arange(len(words)) - np.searchsorted(row, row)
                yield pa.RecordBatch.from_arrays([b.column("row_id").take(pa.array(row[at])), b.column("host").take(pa.array(row[at])), pa.array(_prefix_hash(words, at, size)), pa.array(place[at].astype(np.int32))], ["row_id", "host", "prefix", "place"])

    return run


def _kept(ts: list[str], zs: list[int], covered: set[int], often: set[int]) -> tuple[str, int, int]:
    """(text, blocks that repeat, guarded blocks that do not) of a page with the covered places of its stream; ``often``:
    those of them that runs of SHARE of the host's streams cover."""
    if ARTICLE not in zs and covered != often:
        blocks = [t for t, z in zip(ts, zs, strict=True) if z != ARTICLE]
        if len(covered) > COPY * sum(len(_WORD.findall(t)) for t in blocks):
            covered = often
    kept, at, repeated, guarded = [], 0, 0, 0
    for t, z in zip(ts, zs, strict=True):
        if z != ARTICLE:
            words = _WORD.findall(t)
            own = [w for k, w in enumerate(words) if at + k not in covered]
            gone = 2 * len(own) < len(words)
            repeated, guarded = repeated + gone, guarded + (z == GUARDED and not gone)
            t = "" if z == GUARDED else " ".join(own if gone else words)
            at += len(words)
        if t:
            kept.append(t)
    return "\n".join(kept), repeated, guarded


def _host_hash(hosts: pa.Array) -> np.ndarray:
    raw, at = text_buffers(hosts)
    out = np.zeros(len(hosts), np.uint64)
    words, _, _, row = word_hashes(raw, at, np.zeros(256, bool))  # a host is one word
    out[row] = words
    return out


TEXT = "page_id long, url string, text string, n_repeated long, n_guarded long"


def _texts(b: pa.RecordBatch, kept: list[tuple[str, int, int]]) -> pa.RecordBatch:
    counts = [pa.array([x[k] for x in kept], pa.int64()) for k in (1, 2)]
    return pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array([x[0] for x in kept], pa.string()), *counts], [x.split()[0] for x in TEXT.split(", ")])


def _look_up(size: int, narrow: np.ndarray, wide: np.ndarray):
    """Texts with the repeated prefixes at hand: sorted hashes of (host, prefix)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, row = _streams(b)
            texts, zones = b.column("texts").to_pylist(), b.column("zones").to_pylist()
            places: tuple[dict[int, set[int]], ...] = ({}, {})  # covered, often
            at = np.flatnonzero(row[: len(row) - size + 1] == row[size - 1 :]) if len(row) >= size else np.zeros(0, np.int64)
            if len(at) and len(narrow):
                key = mix64(_host_hash(b.column("host"))[row[at]] ^ _prefix_hash(words, at, size).view(np.uint64))
                begin = np.searchsorted(row, np.arange(b.num_rows))
                for known, found in zip((narrow, wide), places, strict=True):
                    if len(known):
                        hit = at[known[np.minimum(np.searchsorted(known, key), len(known) - 1)] == key]
                        for r, p in zip(row[hit].tolist(), (hit - begin[row[hit]]).tolist(), strict=True):
                            found.setdefault(r, set()).update(range(p, p + size))
            out = [_kept(t, z, *(p.get(i, set()) for p in places)) for i, (t, z) in enumerate(zip(texts, zones, strict=True))]
            yield _texts(b, out)

    return run


def _compose(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in ("texts", "zones", "places", "often")), strict=True)
            spread = lambda places: {p + k for p in places or () for k in range(size)}
            yield _texts(b, [_kept(ts, zs, spread(places), spread(often)) for ts, zs, places, often in rows])

    return run


def main_text(pages: DataFrame, min_tokens: int = MIN_TOKENS, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page; n_repeated blocks that the suffix array took out, n_guarded blocks that
    markup alone did. Eager up to the repeated prefixes."""
    small_batches(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    parsed = written(rows.mapInArrow(_parse, PARSED), "parsed")
    outside = parsed.where("beside <> ''").select("row_id", "host", "beside", "stream")
    one = outside.groupBy("host", "stream").agg(F.min("row_id").alias("row_id"))
    enough = one.groupBy("host").agg(F.greatest(F.lit(PAGES), F.ceil(F.count("*") * SHARE)).alias("enough"))
    shared = outside.join(one.select("row_id"), "row_id", "left_semi").select(outside.columns)
    shared = shared.mapInArrow(_intervals(min_tokens), "host string, prefix long, n long").groupBy("host", "prefix").agg(F.sum("n").alias("n")).where(F.col("n") >= PAGES)
    repeated = written(shared.join(enough, "host").select("host", "prefix", (F.col("n") >= F.col("enough")).alias("wide")), "repeated")
    if repeated.count() <= RUNS:
        found = repeated.toArrow()
        key = mix64(_host_hash(found.column("host").combine_chunks()) ^ found.column("prefix").to_numpy().view(np.uint64))
        every = found.column("wide").to_numpy()
        out = parsed.mapInArrow(_look_up(min_tokens, np.sort(key), np.sort(key[every.astype(bool)])), TEXT)
        return out.withColumn("n_chars", F.length("text").cast("long"))
    places = outside.select("row_id", "host", "beside").mapInArrow(_places(min_tokens), "row_id long, host string, prefix long, place int").join(repeated, ["host", "prefix"])
    covered = places.groupBy("row_id").agg(F.collect_set("place").alias("places"), F.collect_set(F.when(F.col("wide"), F.col("place"))).alias("often"))
    return parsed.join(covered, "row_id", "left").mapInArrow(_compose(min_tokens), TEXT).withColumn("n_chars", F.length("text").cast("long"))
