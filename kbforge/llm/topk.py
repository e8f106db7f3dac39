"""Exact top-k by inner product with block-at-a-time pruning (operator 7).

Vectors become integers floor(scale * x). Candidates are cut into shards, and a shard into blocks
of rows with similar vectors; a block keeps each component's largest and smallest value (its
forward index is the block's matrix). For a query the sum of its components' largest products
bounds every score in a block, so blocks are scored in falling order of their bounds until a
bound lies below the query's k-th best score. A bound equal to it is still scored: a tie may hold
a smaller id.

Queries meet candidates as groups: every (group of queries, shard) pair is one unit of work that
holds a bounded number of rows, and the k best of each are merged. That is queries x rows
comparisons at most, as the contract of an exact search asks, spread evenly over tasks; no row
order, no cluster and no repeated vector makes a larger unit.

Defined cases: vectors that are null, empty or hold null or non-finite components take no part;
rows without id neither; vectors of different lengths never meet (groups are by length); repeated
rows are rows of their own; a query id is asked once (with the smallest of its vectors, if it has
several) and never meets a row of its own id.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .workspace import written

SCORES = "query_id long, vec_id long, score long"
EXACT = float(1 << 53)


def integer_vectors(vectors: DataFrame, scale: int = 256, also: tuple[str, ...] = ()) -> DataFrame:
    """(vec_id, vec, dims, columns in ``also``) with vec = floor(scale * x) as longs, for the rows that take part."""
    x = F.col("embedding").cast("array<double>")
    fine = F.col("vec_id").isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * scale)).alias("vec"), F.size(x).alias("dims"), *also)


def _matrix(table: pa.Table) -> np.ndarray:
    return pc.list_flatten(table["vec"]).to_numpy().reshape(table.num_rows, -1)


def score_blocks(queries: pa.Table, rows: pa.Table, k: int, block_rows: int) -> pa.Table:
    """The k best (query_id, vec_id, score) of each query among ``rows``, ties to the smaller id."""
    q, ids, v = _matrix(queries), rows["vec_id"].to_numpy(), _matrix(rows)
    # Rows that agree in the signs of their first components are neighbours: tighter bounds.
    signs = (v[:, : min(12, v.shape[1])] > 0) @ (1 << np.arange(min(12, v.shape[1])))
    order = np.lexsort((ids, signs))
    ids, v = ids[order], v[order]
    starts = np.arange(0, len(v), block_rows)
    high, low = np.maximum.reduceat(v, starts), np.minimum.reduceat(v, starts)
    if float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * q.shape[1] < EXACT:
        q, v, high, low = (m.astype(np.float64) for m in (q, v, high, low))  # sums below 2^53 are exact
    bounds = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
    out_q, out_v, out_s = [], [], []
    for i, qid in enumerate(queries["vec_id"].to_numpy()):
        best_s, best_v, kth = np.empty(0, v.dtype), np.empty(0, np.int64), None
        for b in np.argsort(-bounds[i], kind="stable"):
            if kth is not None and bounds[i, b] < kth:
                break
            at = slice(starts[b], starts[b] + block_rows)
            s, w = v[at] @ q[i], ids[at]
            take = w != qid
            if kth is not None:
                take &= s >= kth
            if not take.any():
                continue
            best_s, best_v = np.concatenate([best_s, s[take]]), np.concatenate([best_v, w[take]])
            top = np.lexsort((best_v, -best_s))[:k]
            best_s, best_v = best_s[top], best_v[top]
            kth = best_s[-1] if len(best_s) == k else None
        out_q.append(np.full(len(best_v), qid))
        out_v.append(best_v)
        out_s.append(best_s.astype(np.int64))
    return pa.table({"query_id": np.concatenate(out_q), "vec_id": np.concatenate(out_v), "score": np.concatenate(out_s)})


def top_k(vectors: DataFrame, is_query: str = "vec_id % 50 = 0", k: int = 5, scale: int = 256, shard_numbers: int = 1 << 22, query_numbers: int = 1 << 19, block_rows: int = 128) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row for which ``is_query`` holds, the ``k`` others of highest score.

    A unit of work has candidates of about ``shard_numbers`` components in all and queries of about
    ``query_numbers`` (32 MB and 4 MB), whatever the vectors' length, so queries are repeated once a
    shard and candidates once a group; small tables get a shard a core.
    """
    rows = written(integer_vectors(vectors, scale).withColumn("row", F.monotonically_increasing_id()), "vectors")
    counts = rows.agg(F.count("*").alias("rows"), F.count_if(F.expr(is_query)).alias("queries"), F.max("dims").alias("dims")).first()
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    shards = max(1, math.ceil(counts["rows"] * (counts["dims"] or 1) / shard_numbers), min(cores, counts["rows"] // 1024))
    groups = max(1, math.ceil(counts["queries"] * (counts["dims"] or 1) / query_numbers))
    spread = lambda by, n: F.pmod(F.xxhash64(by), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = rows.where(is_query).groupBy("vec_id").agg(F.min("vec").alias("vec")).withColumn("dims", F.size("vec"))
    left = asked.select("vec_id", "vec", "dims", spread("vec_id", groups).alias("group"), every(shards).alias("shard"))
    right = rows.select("vec_id", "vec", "dims", every(groups).alias("group"), spread("row", shards).alias("shard"))

    def search(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        if not queries.num_rows or not candidates.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in ("query_id", "vec_id", "score")})
        return score_blocks(queries, candidates, k, block_rows)

    unit = ["dims", "group", "shard"]
    found = left.groupBy(*unit).cogroup(right.groupBy(*unit)).applyInArrow(search, SCORES)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
