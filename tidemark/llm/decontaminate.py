"""Benchmark passages in documents: CGK embedding and bit-sampling LSH over item-sized windows, exact verification.

Texts are sequences of words (``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased). An item of n words leaks into a document if some
span of it is within k = floor(EDITS * n) word edits of the item.

Windows: for every length n of an item, the n words from every start in the text, fewer at its end. Each goes through
REPEATS independent CGK walks (at step j the word under the cursor is put out, and the cursor moves on by a random bit
of that word and j), which map edit distance to Hamming distance, and BITS sampled positions of each walk form its LSH
key (among the first 7n/4 of its 3n; later on most cursors stand at the end, where all windows are alike); a window is a candidate for every item of its length that has its key in any walk. Candidates are
verified by bit-parallel edit distance over their surroundings. For a window with half of the embedded positions unlike
its item's, the chance to miss is (1 - 0.5^BITS)^REPEATS, below 0.2 %; the windows beside it get a chance each, too.

Windows that cannot match are not embedded. Of a span within k edits of an item of n words, the window at its start
holds at least n - 2k of the item's words and d - 2k of its d different words: k edits change as many words at most,
and as many of the span's can lie beyond the window. So windows with fewer of the words, or different words, that any
item of their length has are left out; this loses no span that starts a window, and needs no knowledge of the item.

Items go to the executors in groups of at most GROUP_BYTES of text; a larger benchmark takes several passes over the
documents. Documents are not shuffled. Null or empty texts and items without words match nothing; items below 1 / EDITS
words match unchanged only. Equal items are reported each. Repeated rows give a row each. Empty tables: empty result.
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, slices, small_batches, text_buffers, word_hashes

EDITS, BITS, REPEATS, GROUP_BYTES = 0.2, 3, 48, 16 << 20
OUT = "doc_id long, item_id long, distance long, start_word long, end_word long"
_PAD = np.uint64(0x0DDBA11)
_GROUPS = 64  # of lengths, for the first of the two bounds
_SLOTS = 1 << 20


_rng = np.random.default_rng(0xC6)
_WALK = _rng.integers(0, 2**64, REPEATS, dtype=np.uint64)


def _keys(x: np.ndarray, length: np.ndarray) -> np.ndarray:
    """LSH keys [row, walk] of rows of x, words padded beyond their length; rows of one length have the same sampled
    positions, and all walks take their steps together."""
    out = np.zeros((len(x), REPEATS), np.uint64)
    x = np.concatenate([x, np.full((len(x), 1), _PAD)], axis=1)
    number = np.arange(REPEATS * BITS, dtype=np.uint64).reshape(REPEATS, BITS)
    for a in range(0, len(x), 512):
        rows, n = x[a : a + 512], length[a : a + 512].astype(np.uint64)
        picks = (mix64(n[:, None, None] * np.uint64(0x9E3779B97F4A7C15) + number) % np.maximum(1, 7 * n // 4)[:, None, None]).astype(np.int16 if n.max() < 1 << 14 else np.int64)
        at, key, row = np.zeros((len(rows), REPEATS), np.int64), np.zeros((len(rows), REPEATS), np.uint64), np.arange(len(rows))[:, None]
        for j in range(int(picks.max()) + 1):
            c = rows[row, at]
            picked = (picks == j).any(axis=2)
            key = np.where(picked, mix64(key * np.uint64(0x2545F4914F6CDD1D) + c), key) if picked.any() else key
            # A random bit of the word, the step and the walk moves the cursor, up to the padding at the end.
            h = (c ^ (_WALK + np.uint64(j * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(32)
            at += ((h * np.uint64(0x94D049BB133111EB)) >> np.uint64(63)).astype(np.int64)
            np.minimum(at, x.shape[1] - 1, out=at)
        out[a : a + 512] = key
    return out


def _myers(item: list[int], text: list[int], anywhere: bool) -> list[int]:
    """Edit distances of the item to spans that end after each word of text: of any start, or of the text's start."""
    n, peq = len(item), {}
    for i, c in enumerate(item):
        peq[c] = peq.get(c, 0) | 1 << i
    full, top = (1 << n) - 1, 1 << n - 1
    pv, mv, score, out = full, 0, n, []
    for c in text:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & full, pv & xh
        score += 1 if ph & top else -1 if mh & top else 0
        ph = (ph << 1 | (0 if anywhere else 1)) & full
        mh = mh << 1 & full
        pv, mv = mh | ~(xv | ph) & full, ph & xv
        out.append(score)
    return out


class Items:
    """A group of benchmark items, ready for matching."""

    def __init__(self, rows: list[tuple[int, str | None]]):
        words, _, _, row = word_hashes(*text_buffers(pa.array([t for _, t in rows], pa.string())))
        at = np.searchsorted(row, np.arange(len(rows) + 1))
        held = [i for i, (ident, _) in enumerate(rows) if ident is not None and at[i] < at[i + 1]]
        self.ids, self.words = [rows[i][0] for i in held], [words[at[i] : at[i + 1]] for i in held]
        self.length = np.array([len(w) for w in self.words], np.int64)
        self.k = (EDITS * self.length + 1e-9).astype(np.int64)
        self.lengths = np.unique(self.length)
        self.tables: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.different: dict[int, int] = {}
        for n in self.lengths.tolist():
            which = np.flatnonzero(self.length == n)
            x = np.stack([self.words[i] for i in which])
            self.different[n] = min(len(np.unique(w)) for w in x)
            keys = _keys(x, np.full(len(x), n)).T
            self.tables[n] = [(k[o], which[o]) for k in keys for o in [np.argsort(k, kind="stable")]]
        # Lengths in groups of neighbours; which groups have a word, by its place in the vocabulary (one more for others).
        self.groups = [g for g in np.array_split(self.lengths, _GROUPS) if len(g)]
        self.vocabulary = np.unique(np.concatenate(self.words)) if held else np.zeros(0, np.uint64)
        self.has = np.zeros((len(self.groups), len(self.vocabulary) + 1), np.uint8)
        for g, lengths in enumerate(self.groups):
            for i in np.flatnonzero(np.isin(self.length, lengths)):
                self.has[g, np.searchsorted(self.vocabulary, self.words[i])] = 1
        # A table of places by a word's low bits; words that share them with another one of the vocabulary are searched.
        slot = (self.vocabulary & np.uint64(_SLOTS - 1)).astype(np.int64)
        self.slots = np.full(_SLOTS, len(self.vocabulary), np.int32)
        self.slots[slot] = np.arange(len(slot))
        self.shared = np.unique(slot[np.bincount(slot, minlength=1)[slot] > 1]) if held else slot

    def places(self, words: np.ndarray) -> np.ndarray:
        """Place of every word in the vocabulary, its length for others."""
        slot = (words & np.uint64(_SLOTS - 1)).astype(np.int32)
        at = self.slots[slot]
        known = np.append(self.vocabulary, np.uint64(0))
        at[known[at] != words] = len(self.vocabulary)
        if len(self.shared):
            some = np.flatnonzero(np.isin(slot, self.shared))
            near = np.minimum(np.searchsorted(self.vocabulary, words[some]), len(self.vocabulary) - 1)
            at[some] = np.where(self.vocabulary[near] == words[some], near, len(self.vocabulary))
        return at

    def windows(self, words: np.ndarray, row: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(length, starts) of the windows that the bounds leave."""
        at, n_words = self.places(words), len(words)
        found = []
        for g, lengths in enumerate(self.groups):
            most = min(int(lengths[-1]), n_words)
            least = int((lengths - 2 * (EDITS * lengths + 1e-9).astype(np.int64)).min())
            total = np.zeros(n_words + most, np.int32)
            np.cumsum(self.has[g][at], dtype=np.int32, out=total[:n_words])
            total[n_words:] = total[n_words - 1]
            count = total[most - 1 :][:n_words].copy()
            count[1:] -= total[: n_words - 1]
            found.append(np.flatnonzero(count >= least))  # counts run into the next text, so they are no less than the window's
        if not any(len(s) for s in found):
            return
        # The place before of the same word in the same text, for texts with windows left.
        begin = np.flatnonzero(np.diff(row, prepend=-1))
        stop = np.repeat(np.append(begin[1:], n_words), np.diff(np.append(begin, n_words)))
        mark = np.zeros(row[-1] + 1, bool)
        mark[row[np.concatenate(found)]] = True
        some = np.flatnonzero(mark[row])
        key = mix64(words[some] + row[some].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        before = np.full(n_words, -1, np.int32)
        before[some[order[1:][same]]] = some[order[:-1][same]]
        for g, lengths in enumerate(self.groups):
            has = self.has[g][at] > 0
            for n in lengths.tolist() if len(found[g]) else ():
                k, left = int(EDITS * n + 1e-9), []
                for i in range(0, len(found[g]), 1 << 14):
                    s = found[g][i : i + (1 << 14)]
                    span = s[:, None] + np.arange(n)
                    ok = span < stop[s][:, None]
                    span = np.where(ok, span, 0)
                    ok &= has[span]
                    enough = ok.sum(axis=1) >= n - 2 * k
                    s, span, ok = s[enough], span[enough], ok[enough]
                    left.append(s[(ok & (before[span] < s[:, None])).sum(axis=1) >= max(1, self.different[n] - 2 * k)])
                if left and sum(map(len, left)):
                    yield n, np.concatenate(left)

    def candidates(self, words: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Distinct (item, first word, row) of windows that share a key with an item of their length in some walk."""
        out, left = [np.zeros((0, 3), np.int64)], list(self.windows(words, row))
        if not left:
            return out[0]
        longest = int(self.length.max())
        padded = np.concatenate([words, np.full(longest, _PAD)])
        starts, lengths = np.concatenate([s for _, s in left]), np.repeat([n for n, _ in left], [len(s) for _, s in left])
        stops = np.minimum(starts + lengths, np.searchsorted(row, row[starts], side="right"))
        for a in range(0, len(starts), 8192):
            start, length = starts[a : a + 8192], lengths[a : a + 8192]
            span = start[:, None] + np.arange(int(length.max()))
            keys = _keys(np.where(span < stops[a : a + 8192][:, None], padded[span], _PAD), length)
            for n in np.unique(length).tolist():
                of = np.flatnonzero(length == n)
                got = []
                for r, (table, item) in enumerate(self.tables[n]):
                    lo, hi = np.searchsorted(table, keys[of, r]), np.searchsorted(table, keys[of, r], side="right")
                    count = hi - lo
                    which = np.repeat(lo - np.cumsum(count) + count, count) + np.arange(count.sum())
                    got.append(np.stack([item[which], np.repeat(start[of], count)], axis=1))
                pairs = np.unique(np.concatenate(got), axis=0)
                if EDITS * n < 1:  # unchanged or not at all
                    same = [bool((padded[s : s + n] == self.words[i]).all()) for i, s in pairs.tolist()]
                    pairs = pairs[np.array(same, bool)]
                out.append(np.column_stack([pairs, row[pairs[:, 1]]]))
        found = np.concatenate(out)
        # An item that matches unchanged has its closest span where it stands first.
        found = found[np.lexsort((found[:, 1], found[:, 2], found[:, 0]))]
        again = (np.diff(found[:, 0], prepend=-1) == 0) & (np.diff(found[:, 2], prepend=-1) == 0) & (self.k[found[:, 0]] == 0)
        return found[~again]

    def verified(self, words: np.ndarray, row: np.ndarray, found: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(row, item, distance, start, end) of the best span for every row and item with a candidate that holds."""
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        reach: dict[tuple[int, int], int] = {}
        order = np.lexsort((found[:, 1], found[:, 0], found[:, 2]))
        for i, start, r in found[order].tolist():
            n, k = len(self.words[i]), self.k[i]
            a, z = np.searchsorted(row, [r, r + 1]).tolist()
            lo, hi = max(a, start - k), min(z, start + n + k)
            if hi <= reach.get((r, i), -1):
                continue
            reach[r, i] = hi
            lo = max(a, lo - n - k) if reach.get((r, i), -1) >= lo else lo
            item, text = self.words[i].tolist(), words[lo:hi].tolist()
            d = _myers(item, text, True)
            low = min(d)
            if low <= k and (low, 0, 0) < best.get((r, i), (k + 1, 0, 0)):
                end = d.index(low) + 1
                back = _myers(item[::-1], text[:end][::-1], False)
                best[r, i] = (low, lo + end - 1 - back.index(low) - a, lo + end - a)
        for (r, i), (d, s, e) in best.items():
            yield r, i, d, s, e


def _gram(words: np.ndarray, size: int) -> np.ndarray:
    n = max(0, len(words) - size + 1)
    h = np.full(n, size, np.uint64)
    for k in range(size):
        h = mix64(h * np.uint64(0x2545F4914F6CDD1D) + words[k : k + n])
    return h


def _leaks(items: Items, texts: pa.Array) -> list[tuple[int, int, int, int, int]]:
    """(row, item id, distance, start, end) over a batch of texts, by slices."""
    raw, at = text_buffers(texts)
    rows = []
    for i, j in slices(at):
        words, _, _, row = word_hashes(raw[at[i] : at[j]], at[i : j + 1] - at[i])
        if len(words) and items.words:
            found = items.candidates(words, row)
            rows += [(r + i, items.ids[k], d, s, e) for r, k, d, s, e in items.verified(words, row, found)]
    return rows


def _matcher(items: Items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = _leaks(items, b.column(1))
            if rows:
                c = [np.array(x) for x in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(c[0])), *(pa.array(x.astype(np.int64)) for x in c[1:])], [x.split()[0] for x in OUT.split(", ")])

    return run


def _groups(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[Items]:
    group, held, any_ = [], 0, False
    for r in benchmark.select(F.col(item_col).cast("long"), F.col(text_col)).toLocalIterator():
        group.append((r[0], r[1]))
        held += len(r[1] or "")
        if held >= GROUP_BYTES:
            yield Items(group)
            group, held, any_ = [], 0, True
    if group or not any_:
        yield Items(group)


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, distance, start_word, end_word: the closest span of each item that leaks into a document."""
    small_batches(docs.sparkSession)
    texts, out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), None
    for items in _groups(benchmark, item_col, item_text_col):
        part = texts.mapInArrow(_matcher(items), OUT)
        out = part if out is None else out.union(part)
    return out


def clean_documents(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """docs without the rows into whose text an item leaks; a filter within each task, without a join."""
    small_batches(docs.sparkSession)
    schema, place = docs.schema, docs.columns.index(text_col)
    for items in _groups(benchmark, item_col, item_text_col):

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                keep[[r for r, *_ in _leaks(items, b.column(place))]] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(run, schema)
    return docs
