"""Exact top-k inner products with block-at-a-time pruning.

Components are terms.  Vectors lie in blocks of a document range with, per component, the largest and smallest
value; a query's bound of a block sums, over its components, the larger of weight times largest and weight times
smallest.  A query takes the blocks by falling bound, scores them through the block's forward index (its matrix),
and stops at the first block whose bound is below its k-th score.

Queries form chunks of a fixed size, blocks form groups of a fixed size; a task holds one chunk and one group, and
hands on at most k rows per query.  The best k of all groups are the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyline.llm.common import durable

SCALE = 256
BLOCK_ROWS = 512
GROUP_ROWS = 16_384  # rows of a group of blocks
CHUNK_QUERIES = 2_048


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id, q: floor(256 * x) of every component; vectors null, empty or with null or non-finite components are left out."""
    x = F.col("embedding")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    q = F.transform(x, lambda v: F.floor(v.cast("double") * SCALE).cast("long"))
    return vectors.where(x.isNotNull() & (F.size(x) > 0) & F.col("vec_id").isNotNull()).where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), q.alias("q"))


def top_in_blocks(qid: np.ndarray, q: np.ndarray, vid: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, score) of each query's k best in these rows; ties to the smaller id; a query's own id is no candidate."""
    order = np.argsort(vid, kind="stable")
    vid, v = vid[order], v[order]
    starts = np.arange(0, len(v), BLOCK_ROWS)
    high, low = np.maximum.reduceat(v, starts, axis=0), np.minimum.reduceat(v, starts, axis=0)
    bound = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
    turn = np.argsort(-bound, axis=1, kind="stable")
    best = np.full((len(q), k), -np.inf)
    best_id = np.full((len(q), k), np.iinfo(np.int64).max)
    alive = np.arange(len(q))
    for step in range(len(starts)):
        block = turn[alive, step]
        on = bound[alive, block] >= best[alive, k - 1]  # an equal bound can still win by its id
        alive, block = alive[on], block[on]
        if not len(alive):
            break
        for b in np.unique(block):
            rows = alive[block == b]
            ids = vid[b * BLOCK_ROWS : (b + 1) * BLOCK_ROWS]
            s = q[rows] @ v[b * BLOCK_ROWS : (b + 1) * BLOCK_ROWS].T
            s = np.where(ids[None, :] == qid[rows, None], -np.inf, s)
            if s.shape[1] > 4 * k:  # the k-th of this block, with all that tie with it
                kth = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
                cut = np.maximum(kth, best[rows, k - 1])
                r, c = np.nonzero(s >= cut[:, None])
            else:
                r, c = np.nonzero(s > -np.inf)
            all_r = np.concatenate([np.repeat(np.arange(len(rows)), k), r])
            all_s = np.concatenate([best[rows].ravel(), s[r, c]])
            all_i = np.concatenate([best_id[rows].ravel(), ids[c]])
            o = np.lexsort((all_i, -all_s, all_r))
            first = np.searchsorted(all_r[o], np.arange(len(rows)))
            take = o[first[:, None] + np.arange(k)]
            best[rows], best_id[rows] = all_s[take], all_i[take]
    r, c = np.nonzero(best > -np.inf)
    return qid[r], best_id[r, c], best[r, c].astype(np.int64)


def exact_top_k(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """query_id, rank, vec_id, score for every vector whose id is divisible by ``every``, against all other vectors.

    Vectors of another length than a query's are no candidates of it.  Repeated ids are candidates each; a query id that
    repeats is asked once per row with equal vector.  An empty table gives no rows.  Other columns are not read.
    """
    rows = durable(quantised(vectors).withColumn("dim", F.size("q")).withColumn("row", F.monotonically_increasing_id()))
    dims = rows.groupBy("dim").agg(F.count("*").alias("n"), F.sum((F.col("vec_id") % every == 0).cast("long")).alias("m")).collect()  # one row per vector length
    n_groups = max([1, *(-(-r["n"] // GROUP_ROWS) for r in dims)])
    n_chunks = max([1, *(-(-r["m"] // CHUNK_QUERIES) for r in dims)])
    group = F.pmod(F.xxhash64("vec_id", "row"), F.lit(n_groups)).cast("int")
    chunk = F.pmod(F.xxhash64("vec_id"), F.lit(n_chunks)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "q"]).select("dim", chunk.alias("chunk"), each(n_groups).alias("group"), F.lit(True).alias("asks"), "vec_id", "q")
    held = rows.select("dim", each(n_chunks).alias("chunk"), group.alias("group"), F.lit(False).alias("asks"), "vec_id", "q")

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        mine = pdf["asks"].to_numpy(bool)
        if mine.all() or not mine.any():
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="int64")})
        m = np.stack(pdf["q"].to_numpy()).astype(np.float64)  # exact below 2**53
        ids = pdf["vec_id"].to_numpy(np.int64)
        a, b, s = top_in_blocks(ids[mine], m[mine], ids[~mine], m[~mine], k)
        return pd.DataFrame({"query_id": a, "vec_id": b, "score": s})

    part = asked.unionByName(held).groupBy("dim", "chunk", "group").applyInPandas(score, "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")  # at most k rows per group of blocks
    return part.select("query_id", F.row_number().over(w).cast("int").alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
