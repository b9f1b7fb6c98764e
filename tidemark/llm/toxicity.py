"""Toxicity by a bidirectional gated recurrent network with attention pooling, over word and character inputs.

Words are runs of letters, A-Z lower-cased. A word's input is a hashed word vector and the mean of its hashed byte
4-gram vectors, each with a first component of evidence (smoothed log odds of the training labels; of the strongest
4-gram). Windows of WINDOW words every STRIDE words cover every whole text, so they overlap. A GRU reads each window
in both directions, attention pools its states, a linear layer gives the window's logit; the text's logit is its
largest, scaled on the training documents to a probability.

Training is in numpy in one task, on at most TRAIN_DOCS labelled documents of each class, of at most TRAIN_CHARS
characters each, taken in the order of a hash of the id, and TRAIN_WINDOWS windows of each; the driver gets the trained
parameters alone (about 4 MB, whatever the input), and a lost executor repeats the training from the same rows. A
positive document teaches by the windows with the strongest evidence, if it has more than the median negative one.
Scoring runs on the executors, one pass, no shuffle; per-word work is done once a distinct word and slice. The label,
language, source and id are never inputs of a score.

Null or wordless text: a window without words, scored by the model's bias. Repeated rows: one output row each. Without
labels of both classes the score is the share of toxic labels (0 if none), and accepted() decides by it too. Empty table: empty result. Other columns
are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, release, slices, small_batches, text_buffers, word_hashes, written

WINDOW, STRIDE = 64, 16
TRAIN_DOCS, TRAIN_CHARS, TRAIN_WINDOWS, EPOCHS, BATCH, STEPS = 1200, 50_000, 8, 4, 128, 300
HIDDEN, DIM, TABLE, GRAM, EVIDENCE = 8, 7, 1 << 16, 4, 5
_MASK = np.uint64(TABLE - 1)
_NOT_LETTER = np.array([b < 128 and not chr(b).isalpha() for b in range(256)])
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint64)


def words_of(raw: np.ndarray, offsets: np.ndarray):
    """Distinct words (bucket, 4-gram buckets, offsets of those), and per token its distinct word and text row."""
    h, start, end, row = word_hashes(raw, offsets, _NOT_LETTER)
    _, first, inverse = np.unique(h, return_index=True, return_inverse=True)
    bucket = (h[first] & _MASK).astype(np.int64)
    s, n = start[first], (end - start)[first]
    # Bytes of every distinct word between two marks, then all 4-grams of each.
    size = n + 2
    at = np.concatenate([[0], np.cumsum(size)])
    owner = np.repeat(np.arange(len(s)), size)
    place = np.arange(at[-1]) - at[:-1][owner]
    body = (place > 0) & (place <= n[owner])
    text = np.full(at[-1], 1, np.uint64)
    text[body] = _LOWER[raw[(s[owner] + place - 1)[body]]]
    grams = np.maximum(size - GRAM + 1, 1)
    gat = np.concatenate([[0], np.cumsum(grams)])
    gowner = np.repeat(np.arange(len(s)), grams)
    gplace = at[:-1][gowner] + np.arange(gat[-1]) - gat[:-1][gowner]
    padded = np.concatenate([text, np.zeros(GRAM, np.uint64)])
    g = np.zeros(gat[-1], np.uint64)
    for k in range(GRAM):
        c = padded[gplace + k]
        c = np.where(gplace + k < at[1:][gowner], c, 0) if len(gowner) else c
        g = g * np.uint64(257) + c
    return bucket, (mix64(g) & _MASK).astype(np.int64), gat, inverse, row


def windows_of(row: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text row, first token, length) of every window; a text without words has one empty window."""
    begin = np.searchsorted(row, np.arange(n_rows + 1))
    count = np.diff(begin)
    each = np.maximum(1, -(-(count - WINDOW) // STRIDE) + 1)
    owner = np.repeat(np.arange(n_rows), each)
    offset = (np.arange(len(owner)) - np.repeat(np.cumsum(each) - each, each)) * STRIDE
    return owner, begin[owner] + offset, np.minimum(WINDOW, count[owner] - offset)


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + x.dtype.type(0.5)


class Model:
    """Parameters p: word and gram tables, evidence, two GRUs, attention, output."""

    def __init__(self, seed: int = 0):
        r = np.random.default_rng(seed)
        n = lambda *s, scale=0.3: r.normal(0, scale, s).astype(np.float32)
        self.evidence = (np.zeros(TABLE, np.float32), np.zeros(TABLE, np.float32))
        self.p = {"word": n(TABLE, DIM, scale=0.05), "gram": n(TABLE, DIM, scale=0.05), "out": n(2 * HIDDEN), "bias": np.zeros(1, np.float32), "att": n(2 * HIDDEN, HIDDEN), "v": n(HIDDEN)}
        for d in "fb":
            self.p |= {f"w{d}": n(2 * DIM + 2, 3 * HIDDEN), f"u{d}": n(HIDDEN, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
        self.scale, self.shift, self.prior = 1.0, 0.0, None

    def inputs(self, bucket, grams, gat):
        p = self.p
        if not len(bucket):
            return np.zeros((0, 2 * DIM + 2), np.float32)
        mean = np.add.reduceat(p["gram"][grams], gat[:-1]) / np.diff(gat)[:, None]
        top = np.maximum.reduceat(self.evidence[1][grams], gat[:-1])
        return np.concatenate([self.evidence[0][bucket][:, None], p["word"][bucket], top[:, None], mean], axis=1).astype(np.float32)

    def forward(self, x, ids, mask, keep=False):
        """Logits of windows: x inputs of distinct words, ids [B, T] into x, mask [B, T]."""
        p, states, tapes = self.p, [], []
        b, t = ids.shape
        for d in "fb":
            proj = x @ p[f"w{d}"] + p[f"c{d}"] if len(x) else np.zeros((1, 3 * HIDDEN), np.float32)
            h, out, tape = np.zeros((b, HIDDEN), np.float32), np.zeros((t, b, HIDDEN), np.float32), {}
            u_zr, u_n = p[f"u{d}"][:, : 2 * HIDDEN], p[f"u{d}"][:, 2 * HIDDEN :]
            for k in range(t) if d == "f" else range(t - 1, -1, -1):
                g = proj[ids[:, k]]
                zr = _sigmoid(g[:, : 2 * HIDDEN] + h @ u_zr)
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                n = np.tanh(g[:, 2 * HIDDEN :] + (r * h) @ u_n)
                m = mask[:, k, None]
                if keep:
                    tape[k] = (h, z, r, n)
                h = h + m * ((1 - z) * (n - h))
                out[k] = h
            states.append(out)
            tapes.append(tape)
        hs = np.concatenate(states, axis=2)
        a = np.tanh(hs @ p["att"])
        e = np.where(mask.T > 0, a @ p["v"], np.float32(-30))
        w = np.exp(e - e.max(axis=0)) * mask.T
        w = w / np.maximum(w.sum(axis=0), 1e-9)
        pooled = (w[:, :, None] * hs).sum(axis=0)
        logit = pooled @ p["out"] + p["bias"][0]
        return (logit, hs, a, w, pooled, tapes) if keep else logit

    def gradients(self, words, ids, mask, y):
        """Loss and gradients for windows with labels y; words = (bucket, grams, gat)."""
        p, x = self.p, self.inputs(*words)
        logit, hs, a, w, pooled, tapes = self.forward(x, ids, mask, keep=True)
        prob = _sigmoid(logit)
        dl = ((prob - y) / len(y)).astype(np.float32)
        g = {"out": pooled.T @ dl, "bias": dl.sum(keepdims=True), "word": None, "gram": None}
        dp = dl[:, None] * p["out"]
        dw = (hs * dp).sum(axis=2)
        de = w * (dw - (w * dw).sum(axis=0))
        dhs = w[:, :, None] * dp
        da = de[:, :, None] * p["v"] * (1 - a * a)
        g["v"] = (de[:, :, None] * a).sum(axis=(0, 1))
        g["att"] = hs.reshape(-1, 2 * HIDDEN).T @ da.reshape(-1, HIDDEN)
        dhs = dhs + da @ p["att"].T
        dx = np.zeros_like(x)
        t = ids.shape[1]
        for c, d in enumerate("fb"):
            u = p[f"u{d}"]
            u_zr, u_n = u[:, : 2 * HIDDEN], u[:, 2 * HIDDEN :]
            dproj, du, dh = np.zeros((len(x), 3 * HIDDEN), np.float32), np.zeros_like(u), np.zeros((len(y), HIDDEN), np.float32)
            for k in range(t - 1, -1, -1) if d == "f" else range(t):
                h, z, r, n = tapes[c][k]
                m = mask[:, k, None]
                dh = dh + dhs[k, :, c * HIDDEN : (c + 1) * HIDDEN]
                dn = dh * m * (1 - z) * (1 - n * n)
                dz = -dh * m * (n - h) * z * (1 - z)
                drh = dn @ u_n.T
                dr = drh * h * r * (1 - r)
                dzr = np.concatenate([dz, dr], axis=1)
                du[:, : 2 * HIDDEN] += h.T @ dzr
                du[:, 2 * HIDDEN :] += (r * h).T @ dn
                np.add.at(dproj, ids[:, k], np.concatenate([dzr, dn], axis=1))
                dh = dh * (1 - m * (1 - z)) + drh * r + dzr @ u_zr.T
            g[f"u{d}"], g[f"w{d}"], g[f"c{d}"] = du, x.T @ dproj, dproj.sum(axis=0)
            dx += dproj @ p[f"w{d}"].T
        bucket, grams, gat = words
        g["word"] = (bucket, dx[:, 1 : DIM + 1])
        n = np.diff(gat)
        g["gram"] = (grams, np.repeat(dx[:, DIM + 2 :] / n[:, None], n, axis=0))
        loss = float(np.mean(np.maximum(logit, 0) - logit * y + np.log1p(np.exp(-np.abs(logit)))))
        return loss, g

    def probability(self, logit):
        return 1 / (1 + np.exp(-np.clip(self.scale * logit + self.shift, -30, 30)))


def _gather(first, length, inverse):
    """ids and mask [B, WINDOW] of windows."""
    at = first[:, None] + np.arange(WINDOW)
    mask = np.arange(WINDOW) < length[:, None]
    ids = inverse[np.minimum(at, len(inverse) - 1)] if len(inverse) else np.zeros(at.shape, np.int64)
    return np.where(mask, ids, 0), mask.astype(np.float32)


def logits(model: Model, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Largest window logit of every text."""
    n = len(offsets) - 1
    bucket, grams, gat, inverse, row = words_of(raw, offsets)
    x = model.inputs(bucket, grams, gat)
    owner, first, length = windows_of(row, n)
    out = np.full(n, -np.inf)
    for i in range(0, len(owner), 1024):
        s = slice(i, i + 1024)
        np.maximum.at(out, owner[s], model.forward(x, *_gather(first[s], length[s], inverse)))
    return out


def _scores(model: Model, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    if model.prior is not None:
        return np.full(len(offsets) - 1, model.prior)
    return model.probability(logits(model, raw, offsets))


def train(texts: list[str | None], labels: list[int], seed: int = 0) -> Model:
    """A model from whole labelled texts."""
    model, y, r = Model(seed), np.array(labels, np.int64), np.random.default_rng(seed)
    if not len(y) or y.min() == y.max():
        model.prior = float(y.mean()) if len(y) else 0.0
        return model
    raw, offsets = text_buffers(pa.array(texts, pa.string()))
    bucket, grams, gat, inverse, row = words_of(raw, offsets)
    # Evidence: in how many contexts (words before it) of each class a word, or a 4-gram, stands. Copies of a passage
    # repeat its contexts and so add nothing, and what few contexts hold is none.
    before = np.concatenate([[len(bucket)], inverse[:-1]]) if len(inverse) else inverse
    code = np.unique((y[row] * len(bucket) + inverse) * (len(bucket) + 1) + before) // (len(bucket) + 1) if len(bucket) else np.zeros(0, np.int64)
    seen, other = (np.bincount(code[code // max(1, len(bucket)) == c] % max(1, len(bucket)), minlength=len(bucket)).astype(np.float64) for c in (1, 0))

    def evidence(keys, seen, other):
        a, b = np.bincount(keys, seen, TABLE), np.bincount(keys, other, TABLE)
        odds = np.log((a + 0.5) / (seen.sum() + 1)) - np.log((b + 0.5) / (other.sum() + 1))
        return (np.clip(odds, -4, 4) * np.where(a + b >= EVIDENCE, (a + b) / (a + b + 4 * EVIDENCE), 0) / 2).astype(np.float32)

    n = np.diff(gat)
    model.evidence = (evidence(bucket, seen, other), evidence(grams, np.repeat(seen, n), np.repeat(other, n)))
    strength = np.zeros(1, np.float32)
    if len(bucket):
        strength = model.evidence[0][bucket] + np.maximum.reduceat(model.evidence[1][grams], gat[:-1])
    owner, first, length = windows_of(row, len(y))
    ids, mask = _gather(first, length, inverse)
    top = np.where(mask > 0, strength[ids], -9).max(axis=1) if len(ids) else np.zeros(0)
    best = np.full(len(y), -np.inf)
    np.maximum.at(best, owner, top)
    order = r.permutation(len(owner))
    rank = np.empty(len(owner), np.int64)
    by = order[np.argsort(owner[order], kind="stable")]
    rank[by] = np.arange(len(by)) - np.searchsorted(owner[by], owner[by])
    # A positive document without evidence beyond the median of negative ones teaches nothing, unless most are so.
    sure = best >= np.quantile(best[y == 0], 0.5)
    sure = sure if sure[y == 1].mean() > 0.25 else np.ones(len(y), bool)
    use = np.where(y[owner] == 1, sure[owner] & (top >= 0.9 * best[owner]), (rank < TRAIN_WINDOWS) | (top >= best[owner]))
    use = np.flatnonzero(use)
    target = y[owner].astype(np.float32)
    step, moments = 0, {}
    for _ in range(max(EPOCHS, -(-STEPS // max(1, len(use) // BATCH)))):  # few documents are seen more often
        for batch in np.array_split(r.permutation(use), max(1, len(use) // BATCH)):
            step += 1
            words, local = np.unique(ids[batch], return_inverse=True)
            if len(bucket):
                m = np.diff(gat)[words]
                at = np.repeat(gat[:-1][words], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                picked = (bucket[words], grams[at], np.concatenate([[0], np.cumsum(m)]))
            else:
                picked = (bucket, grams, gat)
            _, g = model.gradients(picked, local.reshape(len(batch), WINDOW), mask[batch], target[batch])
            for name, d in g.items():
                if isinstance(d, tuple):  # tables: plain descent on the rows that were used
                    np.subtract.at(model.p[name], d[0], 0.5 * np.clip(d[1], -0.1, 0.1))
                    continue
                d = np.clip(d, -1, 1)
                a, b = moments.get(name, (0.0, 0.0))
                a, b = 0.9 * a + 0.1 * d, 0.99 * b + 0.01 * d * d
                moments[name] = (a, b)
                model.p[name] -= (0.01 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    # Scale document logits to probabilities (regularised logistic fit on the training documents).
    z = logits(model, raw, offsets)
    mean, spread = z.mean(), z.std() + 1e-6
    u, w = np.stack([(z - mean) / spread, np.ones(len(z))], axis=1), np.zeros(2)
    for _ in range(50):
        q = 1 / (1 + np.exp(-u @ w))
        w -= np.linalg.solve((u * (q * (1 - q))[:, None]).T @ u + np.diag([1.0, 1e-3]), u.T @ (q - y) + np.array([1.0, 1e-3]) * w)
    model.scale, model.shift = float(w[0] / spread), float(w[1] - w[0] * mean / spread)
    return model


def held_out(ident):
    return F.crc32(ident.cast("string").cast("binary")) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Train on labelled rows that are not held out; see the bounds above."""
    rows = labels.where(~held_out(F.col(id_col)) & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("int").alias("__y"))
    short = docs.where(F.length(F.coalesce(text_col, F.lit(""))) <= TRAIN_CHARS).select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    ids = short.select("__id").join(rows, "__id").distinct()
    picked = None
    for y in (0, 1):
        part = ids.where(F.col("__y") == y).orderBy(F.xxhash64("__id"), "__id").limit(TRAIN_DOCS)
        picked = part if picked is None else picked.union(part)
    sample = short.join(picked, "__id").dropDuplicates(["__id"]).select(F.col("__id").cast("string"), "__text", "__y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)), key=lambda r: (len(r[0]), r[0]))
        model = train([r[1] for r in rows], [r[2] for r in rows])
        del rows
        release()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    # At most 2 * TRAIN_DOCS rows in one task.
    found = written(sample.repartition(1).mapInArrow(run, "model binary"), "toxicity-model").collect()
    return pickle.loads(found[0][0]) if found else train([], [])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score of every row."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, at = text_buffers(b.column(1))
            out = np.zeros(b.num_rows)
            for i, j in slices(at):
                out[i:j] = _scores(model, raw[at[i] : at[j]], at[i : j + 1] - at[i])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out)], ["id", "score"])
        release()

    found = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, score double")
    return found.select(F.col("id").alias(id_col), "score")


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the documents that score the threshold or more. Scores follow the text, so they stay in the row:
    no join, no shuffle."""
    small_batches(docs.sparkSession)
    model, schema = fit(docs, labels, id_col, text_col), docs.schema
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, at = text_buffers(b.column(place))
            keep = np.ones(b.num_rows, bool)
            for i, j in slices(at):
                keep[i:j] = _scores(model, raw[at[i] : at[j]], at[i : j + 1] - at[i]) < threshold
            yield b.filter(pa.array(keep))
        release()

    return docs.mapInArrow(run, schema)
