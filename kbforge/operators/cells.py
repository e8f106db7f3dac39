"""Approximate nearest vectors by coarse cells, with exact scores.

Centres are fitted on a bounded sample; every vector is indexed under its nearest centre. A query
is compared, exactly, with the vectors of the cells whose centres are nearest to it, so its work is
the share of the cells that it probes. Cells of many vectors are cut into shards of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import stored
from .retrieval import _unit_nearest, top


def usable(vector: Column, dims: int | None = None) -> Column:
    """Whether a vector has a direction: no null or non-finite components, not all zero, and ``dims`` of them."""
    x = vector.cast("array<double>")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(x, lambda c: c != 0)
    return F.coalesce(fine & ((F.size(x) == dims) if dims else F.lit(True)), F.lit(False))


def directions(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """The vectors of a column of one length, scaled to length 1."""
    m = pc.list_flatten(column).to_numpy(zero_copy_only=False).reshape(len(column), -1)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def fit_cells(vectors: DataFrame, cells: int, sample: int = 1 << 15, rounds: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """``cells`` centres (rows of length 1) and the directions of the sample, of (vec_id, embedding), by k-means on the ``sample`` vectors of smallest hash; one length of vectors only, the sample's most frequent."""
    rows = vectors.where(usable(F.col("embedding"))).select(F.xxhash64("vec_id").alias("h"), F.col("embedding").cast("array<double>").alias("v"))
    taken = rows.orderBy("h").limit(sample).toArrow()["v"].combine_chunks()
    if not len(taken):
        return np.zeros((0, 0)), np.zeros((0, 0))
    lengths = pc.list_value_length(taken)
    m = directions(taken.filter(pc.equal(lengths, pc.mode(lengths)[0]["mode"])))
    centres = m[np.linspace(0, len(m) - 1, min(cells, len(m))).astype(int)]
    for _ in range(rounds):
        nearest = np.argmax(m @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, m)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), centres)
    return centres, m


def needed_share(centres: np.ndarray, sample: np.ndarray, k: int, aim: float, asked: int = 512) -> float:
    """The share of cells that holds ``aim`` of the ``k`` nearest in the sample of ``asked`` vectors of it, found by comparing them all."""
    own = np.argmax(sample @ centres.T, axis=1)
    some = np.linspace(0, len(sample) - 1, min(asked, len(sample))).astype(int)
    scores = sample[some] @ sample.T
    scores[np.arange(len(some)), some] = -np.inf
    near = np.argsort(-scores, axis=1)[:, :k]
    place = np.argsort(np.argsort(-(sample[some] @ centres.T), axis=1), axis=1)
    ranks = np.take_along_axis(place, own[near], axis=1)
    return float(np.quantile(ranks, aim, method="higher") + 1) / len(centres)


def in_cells(rows: DataFrame, vector: str, centres: np.ndarray, nearest: int = 1) -> DataFrame:
    """``rows`` whose ``vector`` has the centres' length, once for each of its ``nearest`` cells, with ``cell``."""
    shared = rows.sparkSession.sparkContext.broadcast(centres)  # of a chosen size
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", cell int"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            scores = directions(batch.column(vector)) @ shared.value.T
            best = np.argpartition(-scores, nearest - 1, axis=1)[:, :nearest] if nearest < scores.shape[1] else np.tile(np.arange(scores.shape[1]), (len(scores), 1))
            whole = batch.take(pa.array(np.repeat(np.arange(batch.num_rows), best.shape[1])))
            yield pa.RecordBatch.from_arrays([*whole.columns, pa.array(best.ravel().astype(np.int32))], [*batch.schema.names, "cell"])

    return rows.where(usable(F.col(vector), centres.shape[1])).mapInArrow(place, schema)


def approximate_nearest(queries: DataFrame, vectors: DataFrame, k: int = 5, cells: int | None = None, share: float | None = None, aim: float = 0.95, shard_numbers: int = 1 << 22, itself: bool = False) -> DataFrame:
    """(query_id, vec_id, similarity, rank) as ``retrieval.nearest``, among the vectors of the ``share`` of cells nearest to each (query_id, vector).

    ``cells`` defaults to the root of the number of vectors, at most 4096, and ``share`` to what holds
    ``aim`` of the nearest in the sample: little for clustered vectors, most of the cells for
    vectors without any order. Rows whose vector has no
    direction, or another length than most, take no part. A unit of work is a shard of a cell, of
    about ``shard_numbers`` components, with the queries that probe the cell.
    """
    count = vectors.count()
    cells = cells or min(4096, max(1, math.isqrt(count)))
    centres, sample = fit_cells(vectors, cells)
    if not len(centres):
        return _none(queries, vectors)
    share = share or needed_share(centres, sample, k, aim)
    rows = stored(in_cells(vectors.where("vec_id is not null").select("vec_id", F.col("embedding").cast("array<double>").alias("v")), "v", centres), "cells")
    shards = rows.groupBy("cell").agg(F.ceil(F.count("*") * centres.shape[1] / shard_numbers).cast("int").alias("shards"))
    asked = in_cells(queries.where("query_id is not null").select("query_id", F.col("vector").cast("array<double>").alias("v")), "v", centres, max(1, math.ceil(share * len(centres))))
    dealt = F.broadcast(stored(shards, "shards"))  # a row a cell
    left = asked.join(dealt, "cell").select("query_id", "v", "cell", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))
    right = rows.join(dealt, "cell").select("vec_id", "v", F.col("cell").alias("of"), F.pmod(F.xxhash64("vec_id"), F.col("shards")).cast("int").alias("part"))
    kinds = [x.schema[c].dataType.simpleString() for x, c in ((asked, "query_id"), (rows, "vec_id"))]
    met = left.groupBy("cell", "shard").cogroup(right.groupBy("of", "part"))
    found = met.applyInArrow(lambda q, v: _unit_nearest(q, v, k, itself), f"query_id {kinds[0]}, vec_id {kinds[1]}, similarity double")
    return top(found, k, ["query_id"], [F.col("similarity").desc(), F.col("vec_id")])


def _none(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    kinds = [x.schema[c].dataType.simpleString() for x, c in ((queries, "query_id"), (vectors, "vec_id"))]
    return queries.sparkSession.createDataFrame([], f"query_id {kinds[0]}, vec_id {kinds[1]}, similarity double, rank int")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(queries, wanted, found): how many of the ``exact`` (query_id, vec_id) are among ``found``."""
    both = exact.select("query_id", "vec_id").join(found.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    return both.agg(F.countDistinct("query_id").alias("queries"), F.count("*").alias("wanted"), F.count("hit").alias("found"))
