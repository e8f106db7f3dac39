"""Retrieval for many queries at once: postings, BM25, vectors, rank fusion, diversity."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored
from .substrings import TURN_BYTES, substring_hits

#: BM25 and fusion constants.
K1, B = 1.2, 0.75
FUSION_K, VECTOR_WEIGHT, TEXT_WEIGHT, CANDIDATES = 60, 2.0, 1.0, 200


def term_counts(tokens: Column) -> Column:
    """(dl, terms): the length of a row's ``tokens`` and its (term, tf), in order of terms, as runs of its sorted tokens."""
    # inside lambdas, so that no part is evaluated again for each element
    given = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))

    def runs(t: Column) -> Column:
        n = F.size(t)
        new = lambda i: (i == 0) | (F.get(t, i) != F.get(t, i - 1))
        starts = F.when(n > 0, F.filter(F.sequence(F.lit(0), n - 1), new)).otherwise(F.array().cast("array<int>"))
        run = lambda s: F.transform(s, lambda at, j: F.struct(F.get(t, at).alias("term"), (F.coalesce(F.get(s, j + 1), n) - at).cast("long").alias("tf")))
        return F.struct(F.greatest(n, F.lit(0)).cast("long").alias("dl"), given(starts, run).alias("terms"))

    return given(F.sort_array(tokens), runs)


def posting_lists(chunks: DataFrame, tokens: Column, key: str = "chunk_id", scope: str = "project_id") -> DataFrame:
    """(scope, key, dl, terms): a row for each chunk with its length and its (term, tf), in order of terms.

    Terms are counted inside the row, so nothing is shuffled. Store the result
    (``sources.scratch.stored``, or a table partitioned by scope) and ask it many times.
    """
    return chunks.select(scope, key, term_counts(tokens).alias("__r")).select(scope, key, "__r.dl", "__r.terms")


def postings(lists: DataFrame) -> DataFrame:
    """``lists`` (stored ones, best) with a row for each term: (..., dl, term, tf)."""
    rest = [c for c in lists.columns if c != "terms"]
    return lists.select(*rest, F.explode("terms").alias("__p")).select(*rest, "__p.term", "__p.tf")


def with_phrases(chunks: DataFrame, lists: DataFrame, phrases: DataFrame, text: Column, key: str = "chunk_id") -> DataFrame:
    """``lists`` with a term for each phrase of (phrase) that a chunk's lower-cased ``text`` holds, kept whole.

    The phrase table is given by the user and of any size (``substring_hits``); a phrase counts once
    a chunk and does not change its length.
    """
    low = chunks.select(key, F.lower(text).alias("__low"))
    held = substring_hits(low, [key], ["__low"], phrases.where("phrase <> ''"), F.lower("phrase")).withColumnRenamed("found", "term")
    held = held.groupBy(key).agg(F.array_sort(F.collect_set(F.struct("term", F.lit(1).cast("long").alias("tf")))).alias("__more"))
    return lists.join(held, key, "left").withColumn("terms", F.when(F.col("__more").isNull(), F.col("terms")).otherwise(F.concat("terms", "__more"))).drop("__more")


def bm25(queries: DataFrame, lists: DataFrame, k: int = 5, key: str = "chunk_id", k1: float = K1, b: float = B, most_weights: int = 1 << 18, most_best: int = 1 << 22) -> DataFrame:
    """(query_id, key, score, rank): the ``k`` best chunks of each query of (query_id, term), over ``posting_lists``.

    Document frequencies of asked terms, the collection's size and its mean length are sums over the
    lists. The weights of asked terms are one narrow table of query terms; up to ``most_weights`` of
    them go to every task, more go in turns. A task scores its chunks' lists against all queries at
    once as sums over matching terms, keeps the ``k`` best of each query over all that it reads and
    passes only these on: at most tasks x queries x k rows. A turn keeps ``most_best`` of them.
    """
    spark = lists.sparkSession
    terms = queries.select("query_id", "term").where("query_id is not null and term is not null").distinct()
    df = postings(lists.select("terms")).join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    whole = lists.agg(F.count_if(F.col("dl") > 0).alias("n"), F.avg(F.when(F.col("dl") > 0, F.col("dl"))).alias("avgdl")).first()
    n, avgdl = whole["n"], whole["avgdl"] or 1.0
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = stored(terms.join(df, "term").select("query_id", "term", idf.alias("idf")), "weights")
    asking = weights.agg(F.count("*").alias("weights"), F.countDistinct("query_id").alias("queries")).first()
    turns = max(1, math.ceil(asking["weights"] / most_weights), math.ceil(asking["queries"] * k / most_best))
    kinds = [x.schema[c].dataType.simpleString() for x, c in ((weights, "query_id"), (lists, key))]
    found = None
    for turn in range(turns):
        part = weights.where(F.pmod(F.xxhash64("query_id"), F.lit(turns)) == turn).toArrow()  # about ``most_weights`` rows
        shared = spark.sparkContext.broadcast(part)
        scored = lists.where("dl > 0").select(key, "dl", "terms").mapInArrow(_scorer(shared, key, k, k1, b, avgdl), f"query_id {kinds[0]}, {key} {kinds[1]}, score double")
        found = scored if found is None else found.unionByName(scored)
    return top(found, k, ["query_id"], [F.col("score").desc(), F.col(key)])


def _scorer(shared, key: str, k: int, k1: float, b: float, avgdl: float, at_once: int = 1 << 20) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Scores batches of (key, dl, terms) against the ``shared`` weights (query_id, term, idf)."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value.sort_by("term")
        terms, ids = weights["term"].combine_chunks(), weights["query_id"].combine_chunks().unique()
        known = terms.unique()
        query = pc.index_in(weights["query_id"].combine_chunks(), value_set=ids).to_numpy()
        idf = weights["idf"].to_numpy()
        starts = np.searchsorted(pc.index_in(terms, value_set=known).to_numpy(), np.arange(len(known) + 1))
        rows_at_once = max(1, at_once // max(len(ids), 1))
        least, held, waiting = np.zeros(len(ids)), None, []  # each query's k-th best so far; its best; hits since
        for whole in batches:
            for begin, end in _strips(whole.column("terms"), known, starts, rows_at_once, at_once) if len(ids) else ():
                batch = whole.slice(begin, end - begin)
                row, tf, term = _known_terms(batch.column("terms"), known)
                part = tf * (k1 + 1) / (tf + k1 * (1 - b + b * batch.column("dl").to_numpy()[row] / avgdl))
                asked = starts[term + 1] - starts[term]  # queries of each term
                at = np.repeat(starts[term] - np.concatenate([[0], np.cumsum(asked)[:-1]]) if len(term) else starts[:0], asked) + np.arange(asked.sum())
                cell = query[at] * batch.num_rows + np.repeat(row, asked)
                total = np.bincount(cell, weights=idf[at] * np.repeat(part, asked), minlength=len(ids) * batch.num_rows).reshape(len(ids), -1)
                total = np.floor(total * 1e6 + 0.5) / 1e6
                q, r = np.nonzero((total > 0) & (total >= least[:, None]))
                waiting.append(pa.table([pa.array(q), pa.array(total[q, r]), batch.column(key).take(pa.array(r))], names=["q", "score", key]))
                if sum(x.num_rows for x in waiting) > max(at_once, len(ids) * k):
                    held, waiting = _best([held, *waiting], k, key), []
                    at = held["q"].to_numpy()
                    full = np.flatnonzero(np.bincount(at, minlength=len(ids)) == k)
                    least[full] = held["score"].to_numpy()[np.searchsorted(at, full, "right") - 1]
        if held is not None or waiting:
            held = _best([held, *waiting], k, key)
            yield from pa.table([ids.take(held["q"].combine_chunks()), held[key], held["score"]], names=["query_id", key, "score"]).to_batches(1 << 16)

    return score


def _known_terms(lists: pa.Array, known: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, tf, place in ``known``) of the terms of ``lists`` that are known, in order."""
    counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
    flat = pc.list_flatten(lists)
    term = pc.fill_null(pc.index_in(flat.field("term"), value_set=known), -1).to_numpy()
    hit = term >= 0
    return np.repeat(np.arange(len(counts)), counts)[hit], flat.field("tf").to_numpy().astype(float)[hit], term[hit]


def _strips(lists: pa.Array, known: pa.Array, starts: np.ndarray, most_rows: int, most_hits: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows: at most ``most_rows``, and ``most_hits`` hits of terms by queries unless one row has more."""
    row, _, term = _known_terms(lists, known)
    ends = np.cumsum(np.bincount(row, starts[term + 1] - starts[term], len(lists)).astype(np.int64))
    begin = 0
    while begin < len(lists):
        before = ends[begin - 1] if begin else 0
        end = max(begin + 1, min(begin + most_rows, len(lists), int(np.searchsorted(ends, before + most_hits, "right"))))
        yield begin, end
        begin = end


def _best(parts: list[pa.Table | None], k: int, key: str) -> pa.Table:
    """The ``k`` best (q, score, key) of each q, ties to the smaller key, sorted."""
    rows = pa.concat_tables([p for p in parts if p is not None]).sort_by([("q", "ascending"), ("score", "descending"), (key, "ascending")])
    q = rows["q"].to_numpy()
    return rows.filter(pa.array(np.arange(len(q)) - np.searchsorted(q, q) < k))


def top(rows: DataFrame, k: int, groups: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first ``k`` rows of each group in ``order``, with ``rank``; the cut is pushed below the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).where(F.col("rank") <= k)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays; 0 for different lengths or a zero norm."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norm == 0), 0.0).otherwise(dot(a, b) / norm)


def blocked(rows: DataFrame, asked: DataFrame, on: Column, most: int, shard_rows: int = 16384) -> DataFrame:
    """``rows`` joined with ``asked`` on any condition: broadcast up to ``most`` rows asked, by blocks of about ``most`` beyond.

    Beyond, every (block of ``asked``, shard of ``rows``) pair is a unit of its own, so no number of
    rows on either side is refused or makes a larger unit.
    """
    blocks = math.ceil(asked.count() / most)
    if blocks <= 1:
        return rows.join(F.broadcast(asked), on)
    shards = max(1, math.ceil(rows.count() / shard_rows))
    left = rows.withColumns({"__shard": _dealt(rows, shards), "__block": _every(blocks)})
    right = asked.withColumns({"__block_of": _dealt(asked, blocks), "__shard_of": _every(shards)})
    unit = (F.col("__shard") == F.col("__shard_of")) & (F.col("__block") == F.col("__block_of"))
    return left.join(right, unit & on).drop("__shard", "__block", "__shard_of", "__block_of")


def _dealt(rows: DataFrame, n: int) -> Column:
    return F.pmod(F.xxhash64(*rows.columns), F.lit(n)).cast("int")


def _every(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))


def nearest(queries: DataFrame, vectors: DataFrame, k: int = 5, most_queries: int = 4096, shard_rows: int = 16384, itself: bool = False, within: str | None = None) -> DataFrame:
    """(query_id, vec_id, similarity, rank): exact nearest by cosine for any number of (query_id, vector), without a row of the query's own id unless ``itself``.

    Every (block of about ``most_queries`` queries, shard of about ``shard_rows`` vectors) pair is a
    unit of work, compared inside its task; the ``k`` best of each are merged. Queries and vectors
    meet only where they agree in the column ``within``, if one is named.
    """
    group = [within] if within else []
    asked = queries.select("query_id", F.col("vector").cast("array<double>").alias("v"), *group).where("query_id is not null")
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v"), *group).where("vec_id is not null")
    n, cores = rows.count(), rows.sparkSession.sparkContext.defaultParallelism
    shards = max(1, math.ceil(n / shard_rows), min(cores, n // 1024))
    blocks = max(1, math.ceil(asked.count() / most_queries))
    left = asked.withColumns({"block": _dealt(asked, blocks), "shard": _every(shards)})
    right = rows.withColumns({"shard": _dealt(rows, shards), "block": _every(blocks)})
    kinds = [x.schema[c].dataType.simpleString() for x, c in ((asked, "query_id"), (rows, "vec_id"))]
    found = left.groupBy("block", "shard", *group).cogroup(right.groupBy("block", "shard", *group)).applyInArrow(lambda q, v: _unit_nearest(q, v, k, itself), f"query_id {kinds[0]}, vec_id {kinds[1]}, similarity double")
    return top(found, k, ["query_id"], [F.col("similarity").desc(), F.col("vec_id")])


def _unit_nearest(queries: pa.Table, rows: pa.Table, k: int, itself: bool = False, at_once: int = 64) -> pa.Table:
    """The ``k`` best rows of each query, as ``cosine`` rounded to six places has it; null similarities last, NaN first."""
    rows = rows.take(pc.sort_indices(rows["vec_id"]))  # ties go to the smaller id
    ids, asked = rows["vec_id"].to_numpy(), queries["query_id"].to_numpy()
    (lq, mq), (lv, mv) = matrices(queries["v"]), matrices(rows["v"])
    out_q, out_v, out_s = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
    for begin in range(0, len(asked), at_once) if len(ids) else ():
        part = slice(begin, begin + at_once)
        scores = np.zeros((len(lq[part]), len(ids)))  # -inf stands for null
        scores[lq[part] == -1], scores[:, lv == -1] = -np.inf, -np.inf
        for size, (at, m, gap, norm) in mv.items():
            if size in mq:
                qat, qm, qgap, qnorm = mq[size]
                mine = (qat >= begin) & (qat < begin + at_once)
                with np.errstate(all="ignore"):
                    over = qnorm[mine][:, None] * norm[None, :]
                    dot = (qm[mine] @ m.T) / over
                    dot = np.copysign(np.floor(np.abs(dot) * 1e6 + 0.5) / 1e6, dot)
                dot[over == 0] = 0.0
                dot[qgap[mine][:, None] | gap[None, :]] = -np.inf
                scores[np.ix_(qat[mine] - begin, at)] = dot
        keys = np.where(np.isnan(scores), np.inf, scores)
        for i in range(len(scores)):
            others = np.arange(len(ids)) if itself else np.flatnonzero(ids != asked[begin + i])
            key = keys[i, others]
            if len(others) > k:
                fit = np.flatnonzero(key >= np.partition(key, len(key) - k)[len(key) - k])
                others, key = others[fit], key[fit]
            best = others[np.argsort(-key, kind="stable")[:k]]
            out_q.append(np.full(len(best), begin + i))
            out_v.append(best)
            out_s.append(scores[i, best])
    similarity = np.concatenate(out_s)
    taken = [queries["query_id"].take(pa.array(np.concatenate(out_q))), rows["vec_id"].take(pa.array(np.concatenate(out_v)))]
    return pa.table([*taken, pa.array(similarity, mask=np.isneginf(similarity))], names=["query_id", "vec_id", "similarity"])


def matrices(column: pa.ChunkedArray) -> tuple[np.ndarray, dict]:
    """The lengths of the vectors (-1 for null), and by length: their places, matrix, whether a component is null, norms."""
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy().astype(np.int64)
    flat = pc.list_flatten(column).combine_chunks()
    values, gaps = pc.fill_null(flat, 0.0).to_numpy(zero_copy_only=False), pc.is_null(flat).to_numpy(zero_copy_only=False)
    ends, found = np.cumsum(np.maximum(lengths, 0)), {}
    for size in np.unique(lengths[lengths >= 0]).tolist():
        at = np.flatnonzero(lengths == size)
        cells = ends[at][:, None] - size + np.arange(size)[None, :]
        m = values[cells]
        found[size] = at, m, gaps[cells].any(axis=1), np.sqrt((m * m).sum(axis=1))
    return lengths, found


def fuse(ranked: dict[str, tuple[DataFrame, float]], k: int = CANDIDATES, constant: int = FUSION_K, key: str = "chunk_id") -> DataFrame:
    """(query_id, key, score, source): weighted reciprocal ranks summed over retrievers; ``source`` names one, or says both."""
    parts = None
    for name, (rows, weight) in ranked.items():
        part = rows.where(F.col("rank") <= k).select("query_id", key, (F.lit(weight) / (constant + F.col("rank"))).alias("part"), F.lit(name).alias("source"))
        parts = part if parts is None else parts.unionByName(part)
    both = F.when(F.size(F.collect_set("source")) > 1, "both").otherwise(F.min("source"))
    return parts.groupBy("query_id", key).agg(F.round(F.sum("part"), 9).alias("score"), both.alias("source"))


def diversify(hits: DataFrame, k: int, title: str = "title", key: str = "chunk_id", mode: str = "title_order") -> DataFrame:
    """``k`` hits of each query: up to two of a title in two rounds, then the rest.

    In mode ``title_order`` a round goes through the titles in alphabetical order, in mode
    ``score`` by falling score.
    """
    nth = F.row_number().over(Window.partitionBy("query_id", title).orderBy(F.col("score").desc(), key))
    rows = hits.withColumn("round", F.least(nth, F.lit(3)))
    by = [F.when(F.col("round") < 3, F.col(title)).asc_nulls_last()] if mode == "title_order" else []
    return top(rows, k, ["query_id"], [F.col("round"), *by, F.col("score").desc(), F.col(key)])


def shortcut(queries: DataFrame, pages: DataFrame, gate: float = 0.5, turn_bytes: int = TURN_BYTES) -> DataFrame:
    """Curated pages for (query_id, query): 0.7 where the title holds the query, 0.4 where only the content does; only queries whose best passes ``gate``."""
    low = pages.select("slug", F.lower("title").alias("title"), F.lower("content").alias("content"))
    hits = substring_hits(low, ["slug"], ["title", "content"], queries, F.lower("query"), turn_bytes)
    scored = queries.select("query_id", F.lower("query").alias("found")).join(hits, "found").select("query_id", "slug", F.when(F.col("title"), 0.7).otherwise(0.4).alias("score"))
    best = scored.groupBy("query_id").agg(F.max("score").alias("best")).where(F.col("best") > gate).select("query_id")
    return scored.join(best, "query_id", "left_semi")


def quality_gate(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, sufficient, reasons): no hit, a best below 0.3, or a mean of the best three below 0.2 are insufficient."""
    stats = hits.groupBy("query_id").agg(F.max("score").alias("best"), F.avg(F.when(F.col("rank") <= 3, F.col("score"))).alias("mean3"))
    found = queries.select("query_id").distinct().join(stats, "query_id", "left")
    reasons = F.concat_ws(",", F.when(F.col("best").isNull(), "empty"), F.when(F.col("best") < 0.3, "low_top"), F.when(F.col("mean3") < 0.2, "low_mean"))
    return found.select("query_id", (reasons == "").alias("sufficient"), reasons.alias("reasons"))


def expand_queries(queries: DataFrame, prefixes: Sequence[str], rewrites: dict[str, str]) -> DataFrame:
    """(query_id, variant): the query, prefixed forms where the prefix is not in it, and the rewritten form."""
    q = F.col("query")
    rewritten = q
    for old, new in rewrites.items():
        rewritten = F.replace(rewritten, F.lit(old), F.lit(new))
    forms = F.array(q, *[F.when(~F.contains(q, F.lit(p)), F.concat(F.lit(p + " "), q)) for p in prefixes], F.when(rewritten != q, rewritten))
    return queries.select("query_id", F.explode(F.array_distinct(F.filter(forms, lambda x: x.isNotNull()))).alias("variant"))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common distinct tokens; 0 for two empty sets."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def keywords(docs: DataFrame, tokens: Column, stop: Sequence[str], k: int = 20, shortest: int = 2, key: str = "doc_id") -> DataFrame:
    """(key, keyword, score, rank): per document tf * ln(1 + total / count), without stop words and short tokens."""
    terms = docs.select(key, F.explode(tokens).alias("keyword")).where((F.char_length("keyword") >= shortest) & ~F.col("keyword").isin(list(stop)))
    counts = terms.groupBy(key, "keyword").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(key))
    scored = counts.select(key, "keyword", F.round(F.col("n") / total * F.log(1 + total / F.col("n")), 6).alias("score"))
    return top(scored, k, [key], [F.col("score").desc(), F.col("keyword")])


def profile_match(profiles: DataFrame, docs: DataFrame, keywords: Callable[[Column], Column], least: float = 0.3) -> DataFrame:
    """(query_id, doc_id, score) of (query_id, text) and (doc_id, text) that share a keyword.

    A point for each shared keyword, three times the Jaccard similarity of the keywords above
    ``least``, and five if either text contains the other. Pairs come from a join on keywords,
    counted before texts are looked at; a document's text meets it once for each profile that it
    shares enough with to be contained, or to contain.
    """
    q = profiles.select("query_id", "text", keywords(F.col("text")).alias("k")).withColumn("nq", F.size("k"))
    x = docs.select("doc_id", "text", keywords(F.col("text")).alias("k")).withColumn("nd", F.size("k"))
    shared = q.select("query_id", F.explode("k").alias("keyword")).join(x.select("doc_id", F.explode("k").alias("keyword")), "keyword").groupBy("query_id", "doc_id").agg(F.count("*").alias("shared"))
    sized = shared.join(q.select("query_id", "nq"), "query_id").join(x.select("doc_id", "nd"), "doc_id")
    ratio = F.col("shared") / (F.col("nq") + F.col("nd") - F.col("shared"))
    points = F.col("shared") + F.when(ratio > least, 3 * ratio).otherwise(0.0)
    # one contains the other: all keywords but those cut at its ends are shared
    sized = stored(sized.select("query_id", "doc_id", points.alias("points"), (F.col("shared") >= F.least("nq", "nd") - 2).alias("close")), "profiles")
    near = sized.where("close").select("query_id", "doc_id").join(q.select("query_id", F.col("text").alias("a")), "query_id").join(x.select("doc_id", F.col("text").alias("b")), "doc_id")
    inside = near.where(F.contains("a", F.col("b")) | F.contains("b", F.col("a"))).select("query_id", "doc_id", F.lit(5.0).alias("bonus"))
    return sized.join(inside, ["query_id", "doc_id"], "left").select("query_id", "doc_id", F.round(F.col("points") + F.coalesce("bonus", F.lit(0.0)), 6).alias("score"))


def rerank(hits: DataFrame, scorer: Callable[[Column, Column], Column], query: str, content: str, k: int, key: str = "chunk_id") -> DataFrame:
    """The hits of each query sorted anew by ``scorer`` over the query's and the hit's text."""
    scored = hits.drop("rank").withColumn("score", F.round(scorer(F.col(query), F.col(content)), 6))
    return top(scored, k, ["query_id"], [F.col("score").desc(), F.col(key)])


def hybrid(
    queries: DataFrame, terms: DataFrame, asked: DataFrame, pages: DataFrame, excluded: DataFrame, lists: DataFrame, vectors: DataFrame, chunks: DataFrame, scorer: Callable[[Column, Column], Column], k: int = 5
) -> DataFrame:
    """(query_id, chunk_id, slug, title, source, score, rank): search end to end for (query_id, query) with their ``terms`` (query_id, term) and vectors ``asked`` (query_id, vector).

    Queries that curated ``pages`` answer get these only. For the others, chunks less ``excluded``
    (chunk_id) are ranked by ``vectors`` (chunk_id, embedding) and by BM25 over ``lists``, fused,
    cut to 2k, diversified by title to k, and sorted anew by ``scorer``. Queries without vector
    are ranked by BM25 alone.
    """
    curated = top(shortcut(queries, pages), k, ["query_id"], [F.col("score").desc(), F.col("slug")]).join(pages.select("slug", "title"), "slug")
    curated = curated.select("query_id", F.lit(None).cast(chunks.schema["chunk_id"].dataType).alias("chunk_id"), "slug", "title", F.lit("page").alias("source"), "score", "rank")
    curated = stored(curated, "curated")
    rest = stored(queries.join(curated.select("query_id").distinct(), "query_id", "left_anti"), "rest")
    excluded = stored(excluded.select("chunk_id").distinct(), "excluded")  # written, so that a short list meets the wide rows without a shuffle
    allowed = lambda rows: rows.join(excluded, "chunk_id", "left_anti")
    ours = lambda rows: rows.join(rest.select("query_id"), "query_id", "left_semi")
    near = nearest(ours(asked), allowed(vectors).withColumnRenamed("chunk_id", "vec_id"), CANDIDATES, itself=True).withColumnRenamed("vec_id", "chunk_id")
    found = fuse({"vector": (near, VECTOR_WEIGHT), "bm25": (bm25(ours(terms), allowed(lists), CANDIDATES), TEXT_WEIGHT)})
    cut = stored(top(found, 2 * k, ["query_id"], [F.col("score").desc(), F.col("chunk_id")]).drop("rank"), "cut")
    diverse = diversify(chunks.select("chunk_id", "title", "content").join(cut, "chunk_id"), k)
    ranked = rerank(diverse.join(rest, "query_id"), scorer, "query", "content", k)
    return ranked.select("query_id", "chunk_id", F.lit(None).cast("string").alias("slug"), "title", "source", "score", "rank").unionByName(curated)
