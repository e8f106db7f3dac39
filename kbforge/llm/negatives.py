"""Hard negatives by anchor spanning-tree bounds (operator 12).

Vectors become integers floor(scale * x), scores are integer inner products. Anchors are tied into
a spanning tree of smallest edges. A candidate x whose score at a parent anchor p lies in [low, high]
scores at the child c within [low - r, high + r], r = |c - p| * |x|, as (c - p) * x is at most that.
So a child's scores need not be computed: only candidates whose interval meets what is asked there
(the best few, or the best few of a score window) are scored again, the others keep their interval
for the children below.

Two passes find first the positives of each anchor, its best rows of the same label, and then for
each positive the best rows of other labels whose score lies within a window below the positive's.
In both, groups of anchors meet shards of candidates; each (group, shard) is one unit of bounded
size, and the best of all units are merged. Neighbouring anchors share a group, which keeps the
tree's edges short. Bounds only save work, so the rows are exact.

Defined cases: rows without id or label, and vectors that are null, empty or hold null or non-finite
components, take no part; vectors of different lengths never meet; a row never meets rows of its own
id; an anchor id that several rows bear is asked once, with the smallest label and vector; other
repeated rows are rows of their own, also as positives; ties go to the smaller id; an anchor without
positives, or a positive without rows in its window, gives no rows; an empty table gives none;
further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .running import blocked_running_sum
from .topk import EXACT, integer_vectors
from .workspace import written

POSITIVES = "anchor_id long, positive_id long, positive_score long"
NEGATIVES = "anchor_id long, place int, positive_id long, positive_score long, negative_id long, negative_score long"


def spanning_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(parent, edge) of each point in a tree of smallest distances; the first point is the root, its parent -1."""
    n = len(points)
    parent, edge = np.zeros(n, np.int64), np.full(n, np.inf)
    outside = np.ones(n, bool)
    parent[0], edge[0], outside[0], at = -1, 0.0, False, 0
    for _ in range(n - 1):
        away = points - points[at]
        far = np.sqrt(np.einsum("ij,ij->i", away, away))
        nearer = outside & (far < edge)
        parent[nearer], edge[nearer] = at, far[nearer]
        at = int(np.argmin(np.where(outside, edge, np.inf)))
        outside[at] = False
    return parent, edge


def tree_scores(anchors: np.ndarray, rows: np.ndarray, asked: Callable[[int, np.ndarray, np.ndarray], np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(anchor, places, scores) for each anchor: the exact scores of the rows that ``asked`` names.

    ``asked(anchor, low, high)`` gets bounds of the scores of all rows and returns a mask. Small
    subtrees go first, so the bounds of at most log2(anchors) anchors are held at a time.
    """
    if not len(anchors) or not len(rows):
        return
    real = anchors.astype(np.float64)
    parent, edge = spanning_tree(real)
    norms, lengths = np.linalg.norm(rows.astype(np.float64), axis=1), np.linalg.norm(real, axis=1)
    reach = float(np.abs(anchors).max()) * float(np.abs(rows).max()) * anchors.shape[1]
    kind = np.float32 if reach < 1 << 24 else np.float64 if reach < EXACT else np.int64  # sums stay exact
    anchors, rows = anchors.astype(kind), rows.astype(kind)
    children: list[list[int]] = [[] for _ in parent]
    for k, p in enumerate(parent.tolist()):
        if p >= 0:
            children[p].append(k)
    order, weight = [0], np.ones(len(parent), np.int64)
    for k in order:
        order += children[k]
    for k in reversed(order[1:]):
        weight[parent[k]] += weight[k]
    waiting = [(0, None, None)]
    while waiting:
        k, low, high = waiting.pop()
        if low is None:
            low = high = rows @ anchors[k]
            low, high = low.astype(np.float64), high.astype(np.float64)
        else:  # the last terms cover rounding
            r = edge[k] * norms + (1 + 1e-9 * (lengths[k] + lengths[parent[k]]) * norms)
            low, high = low - r, high + r
        places = np.flatnonzero(asked(k, low, high))
        scores = rows[places] @ anchors[k] if 3 * len(places) < len(rows) else (rows @ anchors[k])[places]
        if children[k]:
            low[places] = high[places] = scores
            waiting += [(c, low, high) for c in sorted(children[k], key=weight.__getitem__, reverse=True)]
        yield k, places, scores.astype(np.int64)


def _least(values: np.ndarray, k: int) -> float:
    """The k-th largest value, or minus infinity if there are fewer."""
    return np.partition(values, len(values) - k)[len(values) - k] if len(values) >= k else -np.inf


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best, larger scores first and smaller ids among equal ones."""
    if len(scores) > k:
        fit = scores >= _least(scores, k)
        ids, scores = ids[fit], scores[fit]
    top = np.lexsort((ids, -scores))[:k]
    return ids[top], scores[top]


def _matrix(table: pa.Table) -> np.ndarray:
    return pc.list_flatten(table["vec"]).to_numpy().reshape(table.num_rows, -1)


def unit_positives(anchors: pa.Table, rows: pa.Table, k: int) -> pa.Table:
    """The k best rows of its own label for each anchor of a unit; a tree for each label."""
    q, q_ids, q_labels = _matrix(anchors), anchors["vec_id"].to_numpy(), anchors["label"].to_numpy()
    v, ids, labels = _matrix(rows), rows["vec_id"].to_numpy(), rows["label"].to_numpy()
    found: list[tuple[int, np.ndarray, np.ndarray]] = []
    for label in np.unique(q_labels):
        own, same = np.flatnonzero(q_labels == label), np.flatnonzero(labels == label)
        same_ids = ids[same]

        def asked(a: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
            other = same_ids != q_ids[own[a]]  # noqa: B023
            return other & (high >= _least(low[other], k))

        for a, places, scores in tree_scores(q[own], v[same], asked):
            found.append((q_ids[own[a]], *_best(same_ids[places], scores, k)))
    return pa.table({
        "anchor_id": np.concatenate([np.empty(0, np.int64), *[np.full(len(i), a) for a, i, _ in found]]),
        "positive_id": np.concatenate([np.empty(0, np.int64), *[i for _, i, _ in found]]),
        "positive_score": np.concatenate([np.empty(0, np.int64), *[s for _, _, s in found]]),
    })


def unit_negatives(anchors: pa.Table, rows: pa.Table, k: int, least: int, most: int) -> pa.Table:
    """The k best rows of other labels in the window of each positive of each anchor of a unit."""
    q, q_ids, q_labels = _matrix(anchors), anchors["vec_id"].to_numpy(), anchors["label"].to_numpy()
    v, ids, labels = _matrix(rows), rows["vec_id"].to_numpy(), rows["label"].to_numpy()
    wants = anchors["positives"].to_pylist()
    windows = [[(-(-least * p["positive_score"] // 100), most * p["positive_score"] // 100) for p in w] for w in wants]

    def asked(a: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        other = (labels != q_labels[a]) & (ids != q_ids[a])
        need = np.zeros(len(other), bool)
        for bottom, top in set(windows[a]):
            if bottom <= top:
                fit = other & (low <= top) & (high >= bottom)
                sure = low[fit & (low >= bottom) & (high <= top)]  # within the window whatever their score is
                need |= fit & (high >= _least(sure, k))
        return need

    columns: list[list] = [[] for _ in range(6)]
    for a, places, scores in tree_scores(q, v, asked):
        for place, (want, (bottom, top)) in enumerate(zip(wants[a], windows[a])):
            fit = (scores >= bottom) & (scores <= top)
            best, worth = _best(ids[places[fit]], scores[fit], k)
            for column, value in zip(columns, (q_ids[a], place, want["positive_id"], want["positive_score"])):
                column += [value] * len(best)
            columns[4] += best.tolist()
            columns[5] += worth.tolist()
    names = ["anchor_id", "place", "positive_id", "positive_score", "negative_id", "negative_score"]
    return pa.table({n: pa.array(c, pa.int32() if n == "place" else pa.int64()) for n, c in zip(names, columns)})


def _grouped(anchors: DataFrame, dims: int, group_numbers: int) -> DataFrame:
    """``anchors`` with ``group``: neighbours in the signs of their first components, a bounded number to a group."""
    code = " + ".join(f"if(coalesce(get(vec, {k}), 0) > 0, {1 << k}, 0)" for k in range(8))
    placed = anchors.withColumn("block", F.expr(f"64 * ({code}) + pmod(xxhash64(vec_id), 64)")).withColumn("one", F.lit(1))
    placed = blocked_running_sum(placed, [], "block", [F.col("vec_id")], "one", "position")
    per_group = max(1, group_numbers // max(1, dims))
    return placed.select(*anchors.columns, F.floor(F.col("position") / per_group).cast("int").alias("group"))


def hard_negatives(
    vectors: DataFrame, is_anchor: str = "vec_id % 100 = 0", positives: int = 5, negatives: int = 10, window: tuple[int, int] = (30, 90), scale: int = 256, shard_numbers: int = 1 << 22, group_numbers: int = 1 << 18
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from ``vectors`` (vec_id, embedding, label).

    The rows for which ``is_anchor`` holds are anchors. A row of another label is a negative of a
    positive if its score is between ``window[0]`` and ``window[1]`` percent of the positive's. A unit of
    work has candidates of about ``shard_numbers`` components and anchors of at most
    ``group_numbers``, whatever the vectors' length; small tables get a shard a core.
    """
    rows = integer_vectors(vectors.where("label is not null").withColumn("label", F.col("label").cast("long")), scale, ("label",))
    rows = written(rows.withColumn("uid", F.monotonically_increasing_id()), "vectors")  # so that ``uid`` stays
    counts = rows.agg(F.count("*").alias("rows"), F.max("dims").alias("dims")).first()
    dims, cores = counts["dims"] or 1, vectors.sparkSession.sparkContext.defaultParallelism
    shards = max(1, math.ceil(counts["rows"] * dims / shard_numbers), min(cores, counts["rows"] // 1024))
    anchors = rows.where(is_anchor).groupBy("vec_id").agg(F.min(F.struct("label", "vec")).alias("own")).select("vec_id", "own.label", "own.vec", F.size("own.vec").alias("dims"))
    anchors = written(_grouped(anchors, dims, group_numbers), "anchors")
    every_shard = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    last = anchors.agg(F.max("group").alias("last")).first()["last"] or 0
    right = rows.select("vec_id", "label", "vec", "dims", F.pmod(F.xxhash64("uid"), F.lit(shards)).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(last))).alias("group"))
    unit = ["dims", "group", "shard"]

    def units(asking: DataFrame, search: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
        left = asking.select("*", every_shard)
        return left.groupBy(*unit).cogroup(right.groupBy(*unit)).applyInArrow(search, schema)

    best = Window.partitionBy("anchor_id").orderBy(F.col("positive_score").desc(), "positive_id")
    found = units(anchors, lambda a, r: unit_positives(a, r, positives), POSITIVES)
    found = found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= positives)
    wanted = found.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.sort_array(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("positives"))
    asking = written(anchors.join(wanted, "vec_id"), "asking")

    mined = units(asking, lambda a, r: unit_negatives(a, r, negatives, *window), NEGATIVES)
    best = Window.partitionBy("anchor_id", "place").orderBy(F.col("negative_score").desc(), "negative_id")
    mined = mined.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    return mined.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
