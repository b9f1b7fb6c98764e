"""Exact top-k by inner product of integer vectors, with multi-resolution segment bounds.

A vector is cut into segments; with segment means m and deviations d (root of the summed squared distance from the
mean), the inner product of two vectors is at most sum(length * m_q * m_x + d_q * d_x), equal in form to a lower bound
of their distance. Bounds are computed over 1 segment, then 4, then 16, each only for pairs that the coarser bound
leaves able to reach the query's k-th best exact score so far; exact scores follow for the survivors.

Queries and candidates are dealt into blocks of bounded size by hash; every (query block, candidate block) is one
group. Each keeps k rows a query, and a window ranks them. Nothing is sampled, and no index is kept.

Vectors that are null or hold a null or non-finite component take no part. A query is compared with vectors of its own
dimension. Rows that repeat an id count once (the smallest vector stands). Scores outside of a 64-bit integer are held
at its ends. Empty table or no query: empty result. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 4096
LEVELS = (1, 4, 16)


def _sketch(x: np.ndarray, segments: int) -> np.ndarray:
    """Columns whose inner product bounds that of the vectors."""
    edges = np.linspace(0, x.shape[1], segments + 1).astype(int)
    out = []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if a < b:
            part = x[:, a:b]
            mean = part.mean(axis=1)
            out += [mean * np.sqrt(b - a), np.sqrt(((part - mean[:, None]) ** 2).sum(axis=1))]
    return np.stack(out, axis=1) if out else np.zeros((len(x), 1))


def _wide_topk(qid: np.ndarray, qi: np.ndarray, xid: np.ndarray, xi: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """As block_topk, for components whose sums of products floats do not hold: products of rows scaled by powers of two
    bound each score from both sides, and only pairs that may be among the k best are summed as whole numbers."""
    out, most = [], 2.0**63
    whole = lambda r: [int(v) for v in r]
    (qe, xe) = (np.frexp(np.abs(v).max(axis=1, initial=0))[1] for v in (qi, xi))
    qs, xs = np.ldexp(qi, -qe[:, None]), np.ldexp(xi, -xe[:, None])
    off = (qi.shape[1] + 2) * 2.0**-52
    for i0 in range(0, len(qid), 256):
        ids, q = qid[i0 : i0 + 256], qs[i0 : i0 + 256]
        mid, slack = q @ xs.T, np.abs(q) @ np.abs(xs).T * off
        power = qe[i0 : i0 + 256, None] + xe[None, :]
        with np.errstate(over="ignore"):
            low, high = (np.clip(np.ldexp(m, power), -most, most) for m in (mid - slack, mid + slack))
        own = ids[:, None] == xid[None, :]
        low[own], high[own] = -np.inf, -np.inf
        floor = np.partition(low, len(xid) - k, axis=1)[:, len(xid) - k] if len(xid) >= k else np.full(len(ids), -np.inf)
        for i in range(len(ids)):
            row = whole(qi[i0 + i])
            may = np.flatnonzero((high[i] >= floor[i]) & ~own[i])
            got = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(row, whole(xi[j]), strict=True)))), int(xid[j])) for j in may)[:k]
            out += [(int(ids[i]), j, -s) for s, j in got]
    return out


def block_topk(qid: np.ndarray, q: list, xid: np.ndarray, x: list, k: int) -> list[tuple[int, int, int]]:
    """(query, vector, score) of each query's k best within the block; a query's own id is left out."""
    qi, xi = np.array(q, np.float64), np.array(x, np.float64)
    top = float(max(np.abs(qi).max(initial=0), np.abs(xi).max(initial=0)))
    if qi.ndim < 2 or qi.shape[1] == 0:
        qi, xi = np.zeros((len(q), 1)), np.zeros((len(x), 1))
    exact_float = top * top * qi.shape[1] < 2**53
    out: list[tuple[int, int, int]] = []
    if not exact_float:
        return _wide_topk(qid, qi, xid, xi, k)
    slack = 1e-9 * (top * top * qi.shape[1] + 1)
    sketches = [(_sketch(qi, s), _sketch(xi, s)) for s in LEVELS]
    for i0 in range(0, len(qid), 256):
        ids = qid[i0 : i0 + 256]
        bound = sketches[0][0][i0 : i0 + 256] @ sketches[0][1].T + slack
        bound[ids[:, None] == xid[None, :]] = -np.inf
        rows = np.arange(len(ids))
        # A first floor for each query: exact scores of the vectors with the best coarse bounds.
        take = min(4 * k, len(xid))
        seeds = np.argpartition(-bound, take - 1, axis=1)[:, :take]
        seeded = np.einsum("qd,qkd->qk", qi[i0 : i0 + 256], xi[seeds])
        seeded[np.take_along_axis(bound, seeds, 1) == -np.inf] = -np.inf
        floor = np.partition(seeded, take - k, axis=1)[:, take - k] if take >= k else np.full(len(ids), -np.inf)
        floor = np.where(np.isfinite(floor), floor, -np.inf)
        alive = (bound >= floor[:, None]) & np.isfinite(bound)
        for a, b in sketches[1:]:
            r, c = np.nonzero(alive)
            if len(r) * 2 > alive.size:  # dense: one product is cheaper than picking pairs
                alive &= a[i0 : i0 + 256] @ b.T + slack >= floor[:, None]
            else:
                alive[r, c] = np.einsum("ij,ij->i", a[i0 : i0 + 256][r], b[c]) + slack >= floor[r]
        if alive.sum() * 4 > alive.size:
            score = np.where(alive, qi[i0 : i0 + 256] @ xi.T, -np.inf)
            r, c = np.nonzero(np.isfinite(score) & (score >= floor[:, None]))
            s = score[r, c]
        else:
            r, c = np.nonzero(alive)
            s = np.einsum("ij,ij->i", qi[i0 : i0 + 256][r], xi[c])
        order = np.lexsort((xid[c], -s, r))
        r, c, s = r[order], c[order], s[order]
        first = np.searchsorted(r, rows)
        keep = np.arange(len(r)) - first[r] < k
        out += zip(ids[r[keep]].tolist(), xid[c[keep]].tolist(), np.rint(s[keep]).astype(np.int64).tolist(), strict=True)
    return out


def topk(vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score. is_query: a condition on the id column, as is_query(column)."""
    v = F.col(vector_col)
    ok = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    x = vectors.where(ok & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda c: F.floor(c.cast("double") * scale).cast("double")).alias("v"))
    x = x.groupBy("id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))
    q = x.where(is_query(F.col("id")))
    # Block counts come from counting, so that blocks keep their size at any scale.
    n, nq = x.count(), q.count()
    xb, qb = max(1, -(-n // block_rows)), max(1, -(-nq // block_rows))
    cands = x.select("dim", F.pmod(F.xxhash64("id"), F.lit(xb)).alias("xb"), "id", "v").withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(qb - 1).cast("long"))))
    asks = q.select("dim", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(qb)).alias("qb"), "id", "v").withColumn("xb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(xb - 1).cast("long"))))

    def run(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        rows = block_topk(a["id"].to_numpy(np.int64), list(a["v"]), b["id"].to_numpy(np.int64), list(b["v"]), k) if len(a) and len(b) else []
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).astype("int64")

    found = asks.groupBy("dim", "qb", "xb").cogroup(cands.groupBy("dim", "qb", "xb")).applyInPandas(run, "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
