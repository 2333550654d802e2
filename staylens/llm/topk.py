"""Exact top-k inner products with multi-resolution segment statistics.

Vectors become integers (floor of 256 x).  For a segmentation of the dimensions into segments of
length n, the means m and deviations s of two vectors bound their squared distance from below,

    |q - v|^2 >= sum n ((m_q - m_v)^2 + (s_q - s_v)^2),

and 2 q.v = |q|^2 + |v|^2 - |q - v|^2 turns that into an upper bound of the score.  A task holds
one block of queries and one shard of vectors; it takes a first threshold from the exact scores
of the best coarse bounds, refines the bounds of the pairs that may still beat it, coarse to fine,
and computes exact integer scores for the survivors alone.  The k best of each shard meet per query.

Queries are dealt in blocks and vectors in shards of bounded size, keyed by (block, shard), so no
task holds more than one of each; the number of both grows with the table.

Defined results: null vectors, empty ones and those with a null or non-finite component take no
part, neither as query nor as candidate; vectors are only compared with vectors of their own
dimension; ties go to the smaller id; rows with equal id are separate candidates, but none of
a query with that id; rows repeated with equal id and vector are one query; null ids take no part; a query
without candidates gives no row; further columns are ignored.  Scores must fit 64 bits.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from staylens.session import ship_package

SCALE = 256
SEGMENTS = (1, 4, 16)
SHARD_ROWS = 16_384
BLOCK_ROWS = 512
#: Pairs bounded at a time, pairs multiplied out at a time, and bounds per wanted result that set a threshold.
GROUP_CELLS = 1 << 20
PAIRS = 1 << 16
#: Share of pairs left beyond which a group is multiplied out as a whole.
DENSE = 0.05
FIRST = 4
#: Products and sums below 2^53 are exact in doubles.
EXACT = float(2**53)
SCHEMA = "query_id long, vec_id long, score long"


def segment_statistics(x: np.ndarray, parts: int) -> np.ndarray:
    """Segment means and deviations, each times the root of the segment's length: their squared
    Euclidean distance is the lower bound of the squared distance."""
    out = []
    for seg in np.array_split(x, min(parts, x.shape[1]), axis=1):
        n = seg.shape[1]
        out += [seg.mean(axis=1) * np.sqrt(n), seg.std(axis=1) * np.sqrt(n)]
    return np.stack(out, axis=1)


def exact_in_doubles(q: np.ndarray, v: np.ndarray) -> bool:
    return np.abs(q).max(initial=0.0) * np.abs(v).max(initial=0.0) * q.shape[1] < EXACT


def exact_scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows of ``q`` with those of ``v``, pair by pair."""
    if not exact_in_doubles(q, v):
        return np.einsum("ij,ij->i", q.astype(np.int64), v.astype(np.int64))
    return np.einsum("ij,ij->i", q, v).astype(np.int64)


def upper_bounds(q: np.ndarray, v: np.ndarray, half: np.ndarray) -> np.ndarray:
    """Upper bounds of the scores of all pairs from statistics ``q`` and ``v``; ``half`` is (|q|^2 + |v|^2) / 2 of the vectors.

    |a - b|^2 of the statistics comes from one matrix product."""
    return half - 0.5 * ((q * q).sum(axis=1)[:, None] + (v * v).sum(axis=1)[None, :]) + q @ v.T


def raised(floor: np.ndarray, bound: np.ndarray, q: np.ndarray, v: np.ndarray, k: int) -> np.ndarray:
    """Thresholds: the k-th best exact score among each query's ``FIRST`` x k best bounds, if above ``floor``."""
    n = min(bound.shape[1], FIRST * k)
    if n < k:
        return floor
    first = np.argpartition(bound, bound.shape[1] - n, axis=1)[:, -n:] if n < bound.shape[1] else np.tile(np.arange(n), (len(q), 1))
    rows = np.repeat(np.arange(len(q)), n)
    score = exact_scores(q[rows], v[first.ravel()]).reshape(len(q), n).astype(float)
    score[~np.isfinite(np.take_along_axis(bound, first, axis=1))] = -np.inf  # the query itself
    return np.maximum(floor, np.partition(score, n - k, axis=1)[:, n - k])


def search_cell(qids: np.ndarray, q: np.ndarray, vids: np.ndarray, v: np.ndarray, k: int,
                segments=SEGMENTS) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The k best (query ids, vector ids, scores) of each of a block of queries in one shard.

    Coarse to fine, each resolution bounds the pairs of the vectors that any query of the group still has, raises the
    thresholds by exact scores of the best bounds, and drops the pairs below."""
    qn, vn = (q * q).sum(axis=1), (v * v).sum(axis=1)
    stats = [(segment_statistics(q, s), segment_statistics(v, s)) for s in segments]
    # Rounding slack of the bounds: far above the error of sums of this size.
    slack = 1e-9 * (qn.max(initial=1.0) + vn.max(initial=1.0)) + 1e-6
    out = []
    group = max(1, GROUP_CELLS // max(1, len(vids)))
    for low in range(0, len(qids), group):
        at = slice(low, low + group)
        own = qids[at, None] == vids[None, :]
        alive, floor = np.arange(len(vids)), np.full(len(qids[at]), -np.inf)
        keep = ~own
        for fq, fv in stats:
            half = 0.5 * (qn[at, None] + vn[None, alive]) + slack
            bound = np.where(keep, upper_bounds(fq[at], fv[alive], half), -np.inf)
            floor = raised(floor, bound, q[at], v[alive], k)
            keep = keep & (bound >= floor[:, None])
            some = keep.any(axis=0)
            alive, keep = alive[some], keep[:, some]
        if keep.mean() > DENSE and exact_in_doubles(q[at], v[alive]):
            # Most pairs are left: one matrix product scores them, and only the k best and their ties go on.
            whole = np.where(keep, q[at] @ v[alive].T, -np.inf)
            if len(alive) > k:
                keep = keep & (whole >= np.partition(whole, len(alive) - k, axis=1)[:, len(alive) - k, None])
        rows, columns = np.nonzero(keep)
        found = alive[columns]
        score = np.concatenate([exact_scores(q[at][rows[i:i + PAIRS]], v[found[i:i + PAIRS]]) for i in range(0, len(rows), PAIRS)]
                               or [np.empty(0, np.int64)])
        order = np.lexsort((vids[found], -score, rows))
        rows, found, score = rows[order], vids[found][order], score[order]
        starts = np.searchsorted(rows, np.arange(len(qids[at]) + 1))
        for i, (a, b) in enumerate(zip(starts, starts[1:])):
            b = min(b, a + k)
            if b > a:
                out.append((np.full(b - a, qids[low + i]), found[a:b], score[a:b]))
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
          shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS, segments=SEGMENTS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of ``vectors`` for each row of ``queries``."""
    ship_package(vectors.sparkSession)

    def cleaned(df: DataFrame) -> DataFrame:
        x = F.col("x")
        ints = F.transform(F.col(vector_col), lambda c: F.floor(c.cast("double") * SCALE).cast("double"))
        fine = (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
        raw = F.forall(F.col(vector_col), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
        return (df.where(F.col(id_col).isNotNull() & raw).select(F.col(id_col).cast("long").alias("id"), ints.alias("x"))
                .where(fine).withColumn("dim", F.size("x")))

    v, q = cleaned(vectors), cleaned(queries).dropDuplicates(["id", "x"])
    # Two counts size the blocks; the rows themselves are dealt by hash, so equal ids spread too.
    shards, blocks = (max(1, -(-df.count() // rows)) for df, rows in ((v, shard_rows), (q, block_rows)))
    v = (v.withColumn("shard", F.pmod(F.xxhash64("id", "x"), F.lit(shards)).cast("int"))
         .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))))
    q = (q.withColumn("block", F.pmod(F.xxhash64("id", "x", F.lit(1)), F.lit(blocks)).cast("int"))
         .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))))

    def cell(qs, vs):
        empty = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        if not len(qs) or not len(vs):
            return empty
        found = search_cell(qs["id"].to_numpy(), np.stack(qs["x"].to_numpy()), vs["id"].to_numpy(),
                            np.stack(vs["x"].to_numpy()), k, segments)
        if not found:
            return empty
        a, b, c = (np.concatenate(x) for x in zip(*found))
        return pd.DataFrame({"query_id": a, "vec_id": b, "score": c})

    key = ["block", "shard", "dim"]
    best = q.groupBy(*key).cogroup(v.groupBy(*key)).applyInPandas(cell, SCHEMA)
    rank = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (best.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def top_k_queries(vectors: DataFrame, every: int = 50, id_col: str = "vec_id", **options) -> DataFrame:
    """The queries are the rows whose id is divisible by ``every``."""
    return top_k(vectors, vectors.where(F.col(id_col) % every == 0), id_col=id_col, **options)
