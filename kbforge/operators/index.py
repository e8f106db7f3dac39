"""A search index on disk: postings of several fields, partitioned by term, in blocks that can be skipped.

A block holds the postings of one (term, field) for the chunks of one slot, with the largest term
frequency and the shortest length among them. Slots deal the chunks out evenly by the hash of their
owner, so a frequent term is many blocks and no block outgrows its slot; a chunk's children share
their parent's slot. Blocks lie in folders by the hash of their term, a file for each part of the slots,
sorted by term inside, so a search reads the folders of the asked terms only and skips row groups
between them. Terms are counted inside tasks, and compressed parcels of lists of postings are
shuffled, not single ones. Postings are kept as differences in as few bytes as these need.

A search brings the asked blocks of a slot together, scores each query there, and keeps the best of
each query over all slots of a task. A query whose blocks cannot add up to more than its k-th best
so far, by their largest frequency and shortest length, skips the slot.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import fresh_dir, shuffles_released, stored
from .retrieval import K1, B, top

POSTINGS = "term string, field string, slot long, n long, cf long, max_tf long, min_length long, postings binary, bucket int"
BLOCK = [c.split()[0] for c in POSTINGS.split(", ")]
LISTS = "term string, field string, part int, first long, n long, length long, postings binary"
LIST = [c.split()[0] for c in LISTS.split(", ")]
#: Lists of a bucket and part on their way, as a compressed Arrow stream.
PARCEL = "bucket int, part int, lists binary"
#: A posting; the ``postings`` of a list or block hold them packed.
POSTING = np.dtype([("key", "<i8"), ("owner", "<i8"), ("slot", "<i4"), ("tf", "<i4"), ("length", "<i4")])
#: Numbers that a packed posting has, and the bits of a key below its document's number.
STREAMS, LOW = 6, 31
#: Slots whose postings of a term travel together: a part; and those of ``build_index``, so that lists and parcels stay long.
PART, WIDE = 32, 256
#: The folder of rows without term, which count a field's chunks (n) and tokens (cf).
TOTALS = -1


@dataclass(frozen=True)
class Index:
    """``blocks`` as described above, ``totals`` (field, n, length), and how many folders and slots there are."""

    blocks: DataFrame
    totals: DataFrame
    buckets: int
    slots: int


def build_index(chunks: DataFrame, fields: dict[str, Column], key: str = "chunk_id", owner: str | None = None, slot_chunks: int = 1 << 15, buckets: int = 32, path: str | None = None, batch: int = 0, slots: int | None = None) -> Index:
    """The index of ``chunks``: their ``key`` and ``owner`` (long; itself if none), and the tokens of each of ``fields``.

    ``path`` keeps it where it can be opened again; it lies in the scratch folder otherwise. Chunks
    without key are left out. An index grows by batches of further chunks, built with the same
    ``slots``: document frequencies, numbers and lengths are sums over its batches' blocks and totals.
    A batch that is built again takes its own place.
    """
    spark = chunks.sparkSession
    whose = F.coalesce(F.col(owner), F.col(key)) if owner else F.col(key)
    chunks = chunks.where(F.col(key).isNotNull())
    slots = slots or max(1, math.ceil(chunks.count() / slot_chunks))
    path = path or fresh_dir(spark, "index")
    slot = F.pmod(F.xxhash64(whose), F.lit(slots)).cast("int")
    each = chunks.select(F.col(key).cast("long").alias("key"), whose.cast("long").alias("owner"), slot.alias("slot"), *[tokens.alias(f"tokens_{i}") for i, tokens in enumerate(fields.values())])
    dealt = each.mapInArrow(_parcels(list(fields), buckets), PARCEL).repartition(buckets * math.ceil(slots / WIDE), "bucket", "part")
    dealt = dealt.mapInArrow(_opened, f"bucket int, {LISTS}")
    dealt = dealt.sortWithinPartitions("bucket", "term", "field", "part", "first").select("bucket", "term", "field", "n", "length", "postings")
    writer = dealt.mapInArrow(_blocks, POSTINGS).write.mode("overwrite").option("parquet.enable.dictionary#postings", "false").option("compression", "zstd").option("parquet.compression.codec.zstd.level", 6)
    with shuffles_released(spark):
        writer.partitionBy("bucket").parquet(f"{path}/blocks/batch={batch}")
    counted = spark.read.schema(POSTINGS).parquet(f"{path}/blocks/batch={batch}").where(F.col("bucket") == TOTALS)
    totals = counted.groupBy("field").agg(F.sum("n").alias("n"), F.sum("cf").alias("length")).where("n > 0")
    totals.write.mode("overwrite").parquet(f"{path}/totals/batch={batch}")
    return open_index(spark, path, buckets, slots)


def open_index(spark: SparkSession, path: str, buckets: int, slots: int) -> Index:
    """The index that was built below ``path``."""
    read = lambda name, schema: spark.read.schema(schema).parquet(f"{path}/{name}").drop("batch")
    return Index(read("blocks", f"{POSTINGS}, batch int").where(F.col("bucket") != TOTALS), read("totals", "field string, n long, length long, batch int"), buckets, slots)


def _lister(names: list[str], most_tokens: int = 1 << 20, slots: int = PART) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Chunks (key, owner, slot, a list of tokens for each field) as ``LISTS``: the postings of each (term, field, part of ``slots``) of about ``most_tokens`` tokens, by slot and key, and the field's number of chunks and tokens in a row without term."""

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, tokens = [], 0
        for whole in batches:
            sizes = sum(pc.fill_null(pc.list_value_length(c), 0).to_numpy().astype(np.int64) for c in whole.columns[3:])
            ends = np.cumsum(sizes)
            begin = 0
            while begin < whole.num_rows:
                before = ends[begin - 1] if begin else 0
                end = max(begin + 1, int(np.searchsorted(ends, before + most_tokens - tokens, "right")))
                held.append(whole.slice(begin, end - begin))
                tokens += int(ends[end - 1] - before)
                if tokens >= most_tokens or end < whole.num_rows:
                    yield from _listed(held, names, slots)
                    held, tokens = [], 0
                begin = end
        if held:
            yield from _listed(held, names, slots)

    return lists


def _listed(held: list[pa.RecordBatch], names: list[str], slots: int) -> Iterator[pa.RecordBatch]:
    rows = pa.Table.from_batches(held).combine_chunks()
    key, owner, slot = (rows[c].to_numpy() for c in ("key", "owner", "slot"))
    order = np.lexsort((key, slot))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    for i, name in enumerate(names):
        tokens = pa.concat_arrays(rows[f"tokens_{i}"].chunks) if rows.num_rows else pa.array([], pa.list_(pa.string()))
        length = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy().astype(np.int64)
        coded = pc.list_flatten(tokens).dictionary_encode()
        code = pc.fill_null(coded.indices, -1).to_numpy().astype(np.int64)
        cells = (code * len(order) + np.repeat(place, length))[code >= 0]
        cells, tf = np.unique(cells, return_counts=True)
        code, at = np.divmod(cells, max(len(order), 1))
        at = order[at]
        found = np.empty(len(at), POSTING)
        found["key"], found["owner"], found["slot"], found["tf"], found["length"] = key[at], owner[at], slot[at], tf, length[at]
        part = slot[at] // slots
        starts = np.flatnonzero((np.diff(code, prepend=-1) != 0) | (np.diff(part, prepend=-1) != 0))
        offsets = np.append(starts, len(at))
        one = [coded.dictionary.take(pa.array(code[starts])), pa.array([name] * len(starts), pa.string()), pa.array(part[starts], pa.int32()), pa.array(key[at[starts]]), pa.array(np.diff(offsets)), pa.nulls(len(starts), pa.int64()), _packed(found, offsets)]
        yield pa.RecordBatch.from_arrays(one, LIST)
        of = [pa.nulls(1, pa.string()), pa.array([name]), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int64()), pa.array([int((length > 0).sum())]), pa.array([int(length.sum())]), pa.nulls(1, pa.binary())]
        yield pa.RecordBatch.from_arrays(of, LIST)


def _parcels(names: list[str], buckets: int, most_bytes: int = 1 << 25) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``_lister``'s lists as ``PARCEL``: about ``most_bytes`` of them at once, a parcel for each bucket and part."""
    lister = _lister(names, slots=WIDE)

    def parcels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for lists in lister(batches):
            bucket = [TOTALS if t is None else zlib.crc32(t.encode()) % buckets for t in lists["term"].to_pylist()]
            held.append(pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), *lists.columns], ["bucket", *LIST]))
            size += lists.nbytes
            if size >= most_bytes:
                yield _parcelled(held)
                held, size = [], 0
        if held:
            yield _parcelled(held)

    return parcels


def _parcelled(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    lists = pa.Table.from_batches(held)
    bucket, part = lists["bucket"].to_numpy().astype(np.int64), pc.fill_null(lists["part"], -1).to_numpy().astype(np.int64)
    order = np.argsort(bucket << 32 | part + 1, kind="stable")
    lists, bucket, part = lists.take(pa.array(order)).combine_chunks(), bucket[order], part[order]
    starts = np.flatnonzero((np.diff(bucket, prepend=-2) != 0) | (np.diff(part, prepend=-2) != 0))
    packed, codec = [], pa.Codec("zstd", compression_level=6)
    for begin, end in zip(starts, [*starts[1:], len(order)]):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, lists.schema) as writer:
            writer.write_table(lists.slice(begin, end - begin))
        packed.append(codec.compress(sink.getvalue(), asbytes=True))
    return pa.RecordBatch.from_arrays([pa.array(bucket[starts], pa.int32()), pa.array(part[starts], pa.int32()), pa.array(packed, pa.binary())], ["bucket", "part", "lists"])


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for parcel in batch.column("lists"):
            with pa.CompressedInputStream(pa.BufferReader(parcel.as_buffer()), "zstd") as compressed:
                yield from pa.ipc.open_stream(compressed)


def _zigzag(x: np.ndarray) -> np.ndarray:
    return (x << 1 ^ x >> 63).view(np.uint64)


def _unzigzag(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(1)).view(np.int64) ^ -(x & np.uint64(1)).view(np.int64)


def _to_bytes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unsigned numbers, seven bits a byte, a set high bit where more follow; and where each ends."""
    size, most = np.ones(len(values), np.int64), int(values.max(initial=0))
    for k in range(7, 64, 7):
        if most >> k:
            size += values >= np.uint64(1 << k)
    ends = np.cumsum(size)
    out, at = np.empty(ends[-1] if len(ends) else 0, np.uint8), np.arange(len(values))
    for k in range(10):
        at = at[size[at] > k]
        if not len(at):
            break
        more = (size[at] > k + 1).astype(np.uint8) << 7
        out[ends[at] - size[at] + k] = (values[at] >> np.uint64(7 * k)).astype(np.uint8) & 127 | more
    return out, ends


def _from_bytes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers that ``_to_bytes`` wrote, and how many end at or before each byte."""
    last = raw < 128
    ends = np.flatnonzero(last)
    starts = np.concatenate([np.zeros(min(1, len(ends)), np.int64), ends[:-1] + 1])
    size, values = ends - starts + 1, (raw[starts] & 127).astype(np.uint64)
    at = np.arange(len(values))
    for k in range(1, 10):
        at = at[size[at] > k]
        if not len(at):
            break
        values[at] |= (raw[starts[at] + k] & 127).astype(np.uint64) << np.uint64(7 * k)
    return values, np.cumsum(last)


def _places(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the first numbers of all postings stand, stream by stream inside a row, and how far it is to each next one."""
    n = np.diff(offsets)
    return np.arange(offsets[-1]) + np.repeat((STREAMS - 1) * offsets[:-1], n), np.repeat(n, n)


def _packed(found: np.ndarray, offsets: np.ndarray, at_once: int = 1 << 17) -> pa.Array:
    """Each row's postings: slots and documents as differences from the one before, places, owners as differences from keys, frequencies, lengths."""
    parts, row = [], 0
    while row < len(offsets) - 1:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + at_once, "right")) - 1)
        parts.append(_packed_rows(found[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]))
        row = end
    ends, base = [np.zeros(1, np.int64)], 0
    for _, e in parts:
        ends.append(e + base)
        base += e[-1]
    raw = np.concatenate([np.empty(0, np.uint8), *(r for r, _ in parts)])
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(np.concatenate(ends).astype(np.int32)), pa.py_buffer(raw)])


def _packed_rows(found: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, n = _places(offsets)
    starts = offsets[:-1][np.diff(offsets) > 0]

    def since(x: np.ndarray) -> np.ndarray:
        d = np.diff(x, prepend=0)
        d[starts] = x[starts]
        return _zigzag(d)

    key = found["key"].astype(np.int64)
    values = np.empty(STREAMS * len(found), np.uint64)
    streams = [since(found["slot"].astype(np.int64)), since(key >> LOW), (key & (1 << LOW) - 1).view(np.uint64), _zigzag(found["owner"] - key), *(_zigzag(found[c].astype(np.int64)) for c in ("tf", "length"))]
    for k, stream in enumerate(streams):
        values[at + k * n] = stream
    raw, ends = _to_bytes(values)
    return raw, np.concatenate([[0], ends])[STREAMS * offsets[1:]]


def _unpacked(packed: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The postings of all rows, and where each row's begin and the last one's end."""
    offsets = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1].astype(np.int64)
    data = packed.buffers()[2]
    values, counts = _from_bytes(np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.empty(0, np.uint8))
    offsets = np.concatenate([[0], counts])[offsets - offsets[0]] // STREAMS
    at, n = _places(offsets)
    rows = np.diff(offsets)
    starts = offsets[:-1][rows > 0]

    def summed(d: np.ndarray) -> np.ndarray:
        total = np.cumsum(d)
        return total - np.repeat(total[starts] - d[starts], rows[rows > 0])

    stream = lambda k: values[at + k * n]
    found = np.empty(len(at), POSTING)
    found["slot"] = summed(_unzigzag(stream(0)))
    found["key"] = key = summed(_unzigzag(stream(1))) << LOW | stream(2).view(np.int64)
    found["owner"] = key + _unzigzag(stream(3))
    found["tf"], found["length"] = _unzigzag(stream(4)), _unzigzag(stream(5))
    return found, offsets


def _spans(batch: pa.RecordBatch, most_bytes: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """The batch in parts whose ``postings`` have ``most_bytes``, or one row: they take several times as much unpacked."""
    packed = batch.column("postings")
    ends = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1].astype(np.int64)
    begin = 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(ends, ends[begin] + most_bytes, "right")) - 1)
        yield batch.slice(begin, end - begin)
        begin = end


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted lists of postings as blocks. One that goes on in the next batch, or part of it, continues there as a block of its own."""
    for batch in (part for whole in batches for part in _spans(whole)):
        new = np.zeros(batch.num_rows, bool)
        new[0] = True
        for c in ("bucket", "term", "field"):
            x = batch.column(c)
            new[1:] |= pc.fill_null(pc.not_equal(x[1:], x[:-1]), True).to_numpy(zero_copy_only=False)
        found, offsets = _unpacked(batch.column("postings"))
        row = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
        block = np.cumsum(new)[row] << 32 | found["slot"]
        order = np.argsort(block, kind="stable")  # the lists are sorted already
        found, row, block = found[order], row[order], block[order]
        starts = np.flatnonzero(np.diff(block, prepend=-1))
        ends = np.append(starts, len(found))
        if len(found):
            tf, dl = found["tf"].astype(np.int64), found["length"].astype(np.int64)
            slots = found["slot"][starts].astype(np.int64)
            found["slot"] = 0  # it has a column of its own
            one = [batch.column(c).take(pa.array(row[starts])) for c in ("term", "field")]
            of = [slots, np.diff(ends), np.add.reduceat(tf, starts), np.maximum.reduceat(tf, starts), np.minimum.reduceat(dl, starts)]
            yield pa.RecordBatch.from_arrays([*one, *map(pa.array, of), _packed(found, ends), batch.column("bucket").take(pa.array(row[starts]))], BLOCK)
        counts = batch.filter(pc.is_null(batch.column("term")))
        none = pa.nulls(counts.num_rows, pa.int64())
        yield pa.RecordBatch.from_arrays([counts["term"], counts["field"], none, counts["n"], counts["length"], none, none, pa.nulls(counts.num_rows, pa.binary()), counts["bucket"]], BLOCK)


def asked_blocks(index: Index, terms: DataFrame) -> DataFrame:
    """The blocks of (term): read from the folders that hold any of them."""
    bucket = (F.crc32(F.col("term").cast("binary")) % index.buckets).cast("int")
    folders = [r[0] for r in terms.select(bucket.alias("b")).distinct().collect()]  # at most as many as folders
    return index.blocks.where(F.col("bucket").isin(folders)).join(terms.select("term").distinct(), "term", "left_semi")


def search(
    index: Index, queries: DataFrame, k: int = 5, excluded: DataFrame | None = None, fold: bool = False, k1: float = K1, b: float = B, most_weights: int = 1 << 18, most_best: int = 1 << 22
) -> DataFrame:
    """(query_id, key, score, rank): the ``k`` best chunks of each query of (query_id, term), by BM25 summed over the fields.

    ``excluded`` (key) take no part. With ``fold`` a hit counts for its owner, which has the best score of
    its chunks; ``key`` is then the owner. Queries are taken in turns of at most ``most_weights`` asked
    postings' weights and ``most_best`` kept hits; a task passes on ``k`` rows a query at most.
    """
    spark = index.blocks.sparkSession
    terms = queries.select("query_id", "term").where("query_id is not null and term is not null").distinct()
    totals = index.totals.groupBy("field").agg(F.sum("n").alias("n"), F.sum("length").alias("length")).collect()  # a row a field
    n, length = ({r.field: r[c] for r in totals} for c in ("n", "length"))
    of = lambda d: F.element_at(F.create_map(*[F.lit(x) for kv in d.items() for x in kv]), F.col("field")) if d else F.lit(0)
    df = asked_blocks(index, terms).groupBy("term", "field").agg(F.sum("n").alias("df"))
    idf = F.log(1 + (of(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = stored(terms.join(df, "term").select("query_id", "term", "field", idf.alias("idf")), "weights")
    counts = weights.agg(F.count("*").alias("weights"), F.countDistinct("query_id").alias("queries")).first()
    turns = max(1, math.ceil(counts["weights"] / most_weights), math.ceil(counts["queries"] * k / most_best))
    kind = queries.schema["query_id"].dataType.simpleString()
    mean = {f: length[f] / n[f] for f in n}
    found = None
    for turn in range(turns):
        part = weights.where(F.pmod(F.xxhash64("query_id"), F.lit(turns)) == turn)
        read = asked_blocks(index, part).select("slot", "term", "field", "max_tf", "min_length", "postings")
        if excluded is not None:  # a slot's excluded keys come as a block without term, and first
            gone = excluded.select(F.col(excluded.columns[0]).alias("key"), F.col(excluded.columns[-1]).alias("owner")).distinct()
            gone = gone.groupBy(F.pmod(F.xxhash64("owner"), F.lit(index.slots)).alias("slot")).agg(F.collect_list("key").alias("keys"))
            read = read.unionByName(gone, allowMissingColumns=True)
        slots = read.repartition("slot").sortWithinPartitions(F.col("slot"), F.col("term").asc_nulls_first())
        shared = spark.sparkContext.broadcast(part.toArrow())  # about ``most_weights`` rows
        scored = slots.mapInArrow(_slot_scorer(shared, k, fold, k1, b, mean), f"query_id {kind}, key long, score double")
        found = scored if found is None else found.unionByName(scored)
    return top(found, k, ["query_id"], [F.col("score").desc(), F.col("key")])


class _Best:
    """The best hits of each query so far, ties to the smaller key."""

    def __init__(self, k: int):
        self.k, self.held = k, {}

    def least(self, query: int) -> float:
        keys, scores = self.held.get(query, ((), ()))
        return scores[-1] if len(scores) == self.k else 0.0

    def add(self, query: int, keys: np.ndarray, scores: np.ndarray) -> None:
        if query in self.held:
            keys, scores = np.concatenate([self.held[query][0], keys]), np.concatenate([self.held[query][1], scores])
        if len(scores) > self.k:
            fit = scores >= np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            keys, scores = keys[fit], scores[fit]
        order = np.lexsort((keys, -scores))[: self.k]
        self.held[query] = keys[order], scores[order]


def _slot_scorer(shared, k: int, fold: bool, k1: float, b: float, mean: dict[str, float]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        ids = weights["query_id"].combine_chunks().unique()
        place = {q: i for i, q in enumerate(ids.to_pylist())}
        asked: dict[tuple[str, str], list[tuple[int, float]]] = {}
        for q, term, field, idf in zip(*(weights[c].to_pylist() for c in ("query_id", "term", "field", "idf"))):
            asked.setdefault((term, field), []).append((place[q], idf))
        best = _Best(k)
        part = lambda tf, length, field: tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean[field]))

        def finish(blocks: list[tuple], gone: np.ndarray) -> None:
            if not blocks:
                return
            every, first = np.unique(np.concatenate([x[2] for x in blocks]), return_index=True)
            owners = np.concatenate([x[3] for x in blocks])[first]
            live = ~np.isin(every, gone)
            of_query: dict[int, list[tuple[float, float, np.ndarray, np.ndarray]]] = {}
            for feature, bound, keys, _, parts in blocks:
                at = np.searchsorted(every, keys)
                for q, idf in asked.get(feature, ()):
                    of_query.setdefault(q, []).append((idf * bound, idf, at, parts))
            for q, met in of_query.items():
                if sum(x[0] for x in met) + 1e-5 < best.least(q):
                    continue  # no chunk of the slot can reach the k-th best
                total = np.bincount(np.concatenate([x[2] for x in met]), np.concatenate([x[1] * x[3] for x in met]), len(every))
                hit = np.flatnonzero((total > 0) & live)
                keys, scores = every[hit], np.floor(total[hit] * 1e6 + 0.5) / 1e6
                if fold:
                    keys, where = np.unique(owners[hit], return_inverse=True)
                    most = np.zeros(len(keys))
                    np.maximum.at(most, where, scores)
                    scores = most
                fit = scores >= best.least(q)
                if fit.any():
                    best.add(q, keys[fit], scores[fit])

        slot, blocks, gone = None, [], np.empty(0, np.int64)
        for batch in (part for whole in batches for part in _spans(whole)):
            postings, offsets = _unpacked(batch.column("postings"))
            columns = [batch.column(c).to_pylist() for c in ("slot", "term", "field", "max_tf", "min_length")]
            for row, (at, term, field, max_tf, min_length) in enumerate(zip(*columns)):
                if at != slot:
                    finish(blocks, gone)
                    slot, blocks, gone = at, [], np.empty(0, np.int64)
                if term is None:
                    gone = batch.column("keys")[row].values.to_numpy()
                    continue
                found = postings[offsets[row] : offsets[row + 1]]
                blocks.append(((term, field), part(max_tf, min_length, field), found["key"], found["owner"], part(found["tf"], found["length"], field)))
        finish(blocks, gone)
        held = [(q, keys, scores) for q, (keys, scores) in best.held.items()]
        for begin in range(0, len(held), 1024):
            some = held[begin : begin + 1024]
            at = np.concatenate([np.full(len(keys), q) for q, keys, _ in some])
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array(np.concatenate([x[1] for x in some])), pa.array(np.concatenate([x[2] for x in some]))], ["query_id", "key", "score"])

    return score
