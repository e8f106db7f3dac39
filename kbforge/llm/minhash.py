"""Near-duplicate documents by min-max hashing (operator 5).

Every permutation of a document's shingle hashes gives two signature values, its minimum and its
maximum, so a signature of 2k values costs k hash evaluations a shingle. Both are unbiased for the
Jaccard similarity, and as they are drawn from opposite ends their errors do not add up. Bands of
signature values name candidate pairs; links are confirmed on the full shingle sets.

Work per step, with D documents and B bands:

* one pass over the texts gives (doc_id, key of the text, size, digest of the set, B band keys);
* documents with equal sets fold into one class (a partial aggregate, so thousands of copies
  are no hot group), and only one representative goes on;
* in each bucket every member is first compared with the bucket's smallest representative only.
  Confirmed links are contracted to components; pairs inside a component need no comparison any
  more. Only members of a bucket that still lie in different components, and whose sizes and
  sketches (four bits of each signature value) allow the threshold, are compared in the last round,
  by blocks inside tasks. So a bucket of n near copies costs n comparisons,
  and no link between different texts is lost.

A representative that many others are compared with, and a class that many rows belong to, are
dealt over tasks by salts (``spread_join``, ``confirm``), so no group of copies makes a large task.
What such a step reads more than once is written first: its plan stays small, and so does the
number of stages that the driver starts at once.

Defined cases: null or blank text has size 0 and links with nothing; very long texts are hashed by
blocks; rows that share a doc_id are placed each by its own text; a row without doc_id links with
nothing and is kept; repeated rows are in one class; an empty table gives no rows; further columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shingles import mix, shingle_sets
from .workspace import discard, written

SIGNATURE = "doc_id long, text_key long, n_shingles long, set_key binary, bands array<long>, sketch array<long>"
#: Shingles hashed at once under all permutations: bounds the memory of a very long text.
BLOCK = 1 << 12


def _permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (seeds[:count] | np.uint64(1))[:, None], seeds[count:][:, None]


def min_max(hashes: np.ndarray, multipliers: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """The minimum and maximum of ``hashes`` under each permutation x -> ax + b of 64-bit values."""
    low = np.full(len(multipliers), np.iinfo(np.uint64).max, np.uint64)
    high = np.zeros(len(multipliers), np.uint64)
    for at in range(0, len(hashes), BLOCK):
        v = multipliers * hashes[None, at : at + BLOCK]
        v += shifts
        np.minimum(low, v.min(axis=1), out=low)
        np.maximum(high, v.max(axis=1), out=high)
    return np.stack([low, high], axis=1)


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, text_key)."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"))


def signatures(docs: DataFrame, width: int = 5, bands: int = 24, perms_per_band: int = 3) -> DataFrame:
    """(doc_id, text_key, n_shingles, set_key, bands, sketch) of each document; ``text_key`` is the text's xxhash64.

    A band key covers the minima and maxima of ``perms_per_band`` permutations. The sketch keeps
    four bits of every signature value, sixteen values to a long.
    """
    count = bands * perms_per_band

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        multipliers, shifts = _permutations(count)
        salts = mix(np.arange(1, bands + 1, dtype=np.uint64))
        places = np.arange(0, 64, 4, dtype=np.uint64)
        for batch in batches:
            sizes, digests, keys, sketches = [], [], [], []
            for hashes in shingle_sets(batch.column("text"), width):
                sizes.append(len(hashes))
                digests.append(xxhash.xxh3_128_digest(hashes.tobytes()))
                if len(hashes):
                    values = min_max(hashes, multipliers, shifts).reshape(bands, 2 * perms_per_band)
                    key = salts.copy()
                    for column in values.T:
                        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + column)
                    keys.append(key.view(np.int64))
                    nibbles = np.zeros(-(-2 * count // 16) * 16, np.uint64)
                    nibbles[: 2 * count] = mix(values.ravel()) & np.uint64(15)
                    sketches.append((nibbles.reshape(-1, 16) << places).sum(axis=1, dtype=np.uint64).view(np.int64))
                else:
                    keys.append(np.empty(0, np.int64))
                    sketches.append(keys[-1])
            lists = lambda parts: pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *parts])))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), lists(keys), lists(sketches)],
                ["doc_id", "text_key", "n_shingles", "set_key", "bands", "sketch"],
            )

    return _keyed(docs).mapInArrow(sign, SIGNATURE)


def most_apart(values: int, percent: int) -> int:
    """How many of ``values`` sketch values may differ: six standard deviations beyond what the threshold gives (a chance of 1e-9)."""
    q = percent / 100 + (1 - percent / 100) / 16
    return values - int(values * q - 6 * (values * q * (1 - q)) ** 0.5)


def alike(x: str, y: str, values: int, percent: int) -> str:
    """SQL for whether two sketches (arrays of longs) can belong to sets of at least the threshold.

    Values that differ show in one of their four bits, so a match has a chance of J + (1 - J) / 16.
    """
    apart = []
    for k in range(-(-values // 16)):
        d = f"({x}[{k}] ^ {y}[{k}])"
        apart.append(f"bit_count(({d} | shiftrightunsigned({d}, 1) | shiftrightunsigned({d}, 2) | shiftrightunsigned({d}, 3)) & 1229782938247303441L)")
    return f"({' + '.join(apart)}) <= {most_apart(values, percent)}"


def spread_join(rows: DataFrame, lookup: DataFrame, key: str, by: str, salts: int = 256, how: str = "inner") -> DataFrame:
    """``rows`` joined (``how``: inner or left) with ``lookup`` (one row a ``key``), where any number of rows may share a key.

    Rows are dealt by ``key`` and a salt of ``by``; the lookup first goes to the salts that occur, so a
    key with one row costs nothing and one with many is shared by ``salts`` tasks.
    """
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    return salted.join(salted.select(key, "__salt").distinct().join(lookup, key), [key, "__salt"], how).drop("__salt")


def common(x: np.ndarray, y: np.ndarray) -> int:
    """How many values two sorted arrays of distinct values share."""
    return len(np.intersect1d(x, y, assume_unique=True))


def linked_sets(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = common(x, y)
    return 100 * both >= percent * (len(x) + len(y) - both)


def confirm(pairs: DataFrame, sets: DataFrame, percent: int, per_salt: int = 64) -> DataFrame:
    """(a, b, linked) of the (a, b) in ``pairs``, on the full shingle sets of ``sets`` (rep, hashes).

    The set of an ``a`` with many partners goes to a salt for each ``per_salt`` of them; every
    ``b`` brings its own set there, so no task meets more than a bounded number of pairs of one ``a``.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = zip(batch.column("x"), batch.column("y"))
            linked = [linked_sets(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent) for x, y in sides]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / per_salt).cast("int").alias("salts"))
    dealt = spread_join(pairs.select("a", "b"), salts, "a", "b").withColumn("salt", F.pmod(F.hash("b"), F.col("salts")))
    left = salts.join(sets, F.col("a") == F.col("rep")).select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("hashes").alias("x"))
    both = dealt.join(sets, F.col("b") == F.col("rep")).select("a", "b", "salt", F.col("hashes").alias("y")).join(left, ["a", "salt"])
    return both.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long, linked boolean")


def _unit_links(rows: list[dict], percent: int, values: int) -> list[tuple[int, int]]:
    """Links between members of one unit in different components: enough to join all that belong together."""
    crossed = rows[0]["i"] != rows[0]["j"]
    block, comp = np.array([r["block"] for r in rows]), np.array([r["comp"] for r in rows])
    if (comp == comp[0]).all():
        return []
    band = rows[0]["bands"].index(rows[0]["key"])
    keys = np.array([r["bands"][:band] for r in rows], np.int64).reshape(len(rows), -1)
    longs = np.array([r["sketch"] for r in rows], np.int64).view(np.uint64)
    sketch = (longs[:, :, None] >> np.arange(0, 64, 4, dtype=np.uint64) & np.uint64(15)).astype(np.uint8).reshape(len(rows), -1)[:, :values]
    sets = [np.frombuffer(r["hashes"], np.uint64) for r in rows]
    size = np.array([len(x) for x in sets])
    root = {c: c for c in comp.tolist()}

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    links, least = [], values - most_apart(values, percent)
    for x in range(len(rows) - 1):
        y = slice(x + 1, len(rows))
        fit = (comp[y] != comp[x]) & (100 * np.minimum(size[y], size[x]) >= percent * np.maximum(size[y], size[x]))
        if crossed:
            fit &= block[y] != block[x]
        at = x + 1 + np.flatnonzero(fit)
        at = at[~(keys[at] == keys[x]).any(axis=1)]  # met in an earlier band
        at = at[(sketch[at] == sketch[x]).sum(axis=1) >= least]
        for k in at.tolist():
            p, q = find(int(comp[x])), find(int(comp[k]))
            if p != q and linked_sets(sets[x], sets[k], percent):
                root[max(p, q)] = min(p, q)
                links.append((rows[x]["rep"], rows[k]["rep"]))
    return links


def link_leftovers(placed: DataFrame, classes: DataFrame, sets: DataFrame, percent: int, values: int, unit: int = 512, unit_bytes: int = 32 << 20) -> DataFrame:
    """(a, b): links between members of a bucket that lie in different components, from (key, m, bytes, rep, comp).

    A bucket of ``m`` members is dealt into blocks of about ``unit``, or of about ``unit_bytes`` of
    shingle sets if that is less, and each pair of blocks is one unit of work, compared inside its
    task; pairs are never rows. A pair that shares several buckets is compared in the first only.
    """
    blocks = F.ceil(F.greatest(F.col("m") / unit, F.col("bytes") / unit_bytes)).cast("int")
    rows = placed.withColumn("block", F.pmod(F.hash("rep"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "comp")
    needed = placed.select("rep").distinct()
    whole = classes.select("rep", "bands", "sketch").join(needed, "rep", "left_semi").join(sets, "rep")
    unit_key = ["key", "i", "j"]
    rows = rows.join(whole, "rep").repartition(*unit_key).sortWithinPartitions(*unit_key)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            links = []
            for row in batch.to_pylist():
                here = tuple(row[k] for k in unit_key)
                if here != at:
                    if held:
                        links += _unit_links(held, percent, values)
                    at, held = here, []
                held.append(row)
            yield _link_batch(links)
        if held:
            yield _link_batch(_unit_links(held, percent, values))

    return rows.mapInArrow(search, "a long, b long")


def _link_batch(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest id reachable over ``edges`` (a, b), for each id that they hold.

    Each round hooks every node to its smallest neighbour, follows that pointer twice and contracts
    the edges, so the rounds grow with the logarithm of a component's diameter. Nothing is
    collected; rows are two ids wide, and a pointer that many follow is dealt by salts.
    """
    edges = written(edges.select("a", "b").where("a <> b").distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        ends = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = written(ends.groupBy(F.col("a").alias("x")).agg(F.least(F.min("b"), F.col("a")).alias("y")), "hook")
        hook = near
        for _ in range(2):
            jump = hook.select(F.col("x").alias("y"), F.col("y").alias("z"))
            hook = spread_join(hook, jump, "y", "x").select("x", F.col("z").alias("y"))
        hook = written(hook, "hook")
        if labels is None:
            labels = hook.select(F.col("x").alias("node"), F.col("y").alias("component"))
        else:
            step = hook.select(F.col("x").alias("component"), "y")
            labels = spread_join(labels, step, "component", "node", how="left").select("node", F.coalesce("y", "component").alias("component"))
        labels = written(labels, "labels")
        a = hook.select(F.col("x").alias("a"), F.col("y").alias("a2"))
        b = hook.select(F.col("x").alias("b"), F.col("y").alias("b2"))
        contracted = spread_join(spread_join(edges, a, "a", "b"), b, "b", "a").where("a2 <> b2")
        contracted = written(contracted.select(F.col("a2").alias("a"), F.col("b2").alias("b")).distinct(), "edges")
        discard(edges, near, hook)
        edges = contracted
    if labels is None:
        labels = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels


def _labelled(rows: DataFrame, labels: DataFrame, column: str, name: str, by: str) -> DataFrame:
    labels = labels.select(F.col("node").alias(column), F.col("component").alias(name))
    return spread_join(rows, labels, column, by, how="left").withColumn(name, F.coalesce(name, column))


def _class_links(classes: DataFrame, texts: DataFrame, repeated: bool, width: int, percent: int, values: int, unit: int) -> DataFrame:
    """(node, component) over the ``rep`` of ``classes``, for those that are linked with another; ``texts`` is (doc_id, text_key, text), with ``repeated`` rows or not."""
    members = classes.select("rep", F.explode("bands").alias("key"))  # a band's number is in its key
    shared = members.groupBy("key").agg(F.min("rep").alias("centre"), F.max("rep").alias("last")).where("centre < last").drop("last")
    buckets = written(spread_join(members, shared, "key", "rep"), "buckets")  # only members of buckets that hold several
    known = written(classes.join(buckets.select("rep").distinct(), "rep", "left_semi").select("rep", "n", "sketch", "doc_id", "text_key"), "known")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x.tobytes() for x in shingle_sets(batch.column("text"), width)]
            yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array(found, pa.binary())], ["rep", "hashes"])

    needed = texts.join(known.select("doc_id", "text_key", "rep"), ["doc_id", "text_key"])
    sets = needed.select("rep", "text").mapInArrow(hashed, "rep long, hashes binary")
    sets = written(sets.dropDuplicates(["rep"]) if repeated else sets, "sets")

    close = f"100 * least(n, m) >= {percent} * greatest(n, m)"  # no smaller similarity is possible
    stars = buckets.where("rep <> centre").select(F.col("centre").alias("a"), F.col("rep").alias("b")).distinct()
    stars = stars.join(known.select(F.col("rep").alias("b"), F.col("n").alias("m"), F.col("sketch").alias("other")), "b")
    stars = spread_join(stars, known.select(F.col("rep").alias("a"), "n", "sketch"), "a", "b").where(close + " and " + alike("sketch", "other", values, percent))
    stars = written(stars.select("a", "b"), "stars")

    # First each member with its smallest centre, then with centres in other components.
    first = written(stars.groupBy("b").agg(F.min("a").alias("a")), "first")
    checked = written(confirm(first, sets, percent), "checked")
    labels = components(checked.where("linked"))
    rest = written(_labelled(stars.join(first, ["a", "b"], "left_anti"), labels, "a", "ca", "b"), "rest")
    apart = written(_labelled(rest, labels, "b", "cb", "a").where("ca <> cb").select("a", "b"), "apart")
    checked_2 = written(confirm(apart, sets, percent), "checked")
    links = checked.where("linked").select("a", "b").unionByName(checked_2.where("linked").select("a", "b"))
    labels = components(links)

    # What is left of a bucket: members of different components that no centre has linked.
    lying = written(_labelled(buckets.select("key", "rep"), labels, "rep", "comp", "key"), "lying")
    sized = lying.join(known.select("rep", "n"), "rep")
    mixed = sized.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("m"), (8 * F.sum("n")).alias("bytes")).where("low < high").select("key", "m", "bytes")
    placed = written(spread_join(lying, mixed, "key", "rep"), "mixed")
    left = written(link_leftovers(placed, classes, sets, percent, values, unit), "left")
    labels = components(links.unionByName(left))
    discard(buckets, known, sets, stars, first, rest, apart, checked, checked_2, lying, placed, left)
    return labels


def place(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = 24, perms_per_band: int = 3, unit: int = 512) -> DataFrame:
    """(doc_id, text_key, n_shingles, first) for each row of ``docs``: ``first`` is the smallest (doc_id, text_key) of its group.

    It is null for rows that link with nothing by definition: those without id or words.
    """
    signed = signatures(docs, width, bands, perms_per_band).withColumn("uid", F.monotonically_increasing_id())
    signed = written(signed, "signed")  # so that ``uid`` stays
    able = signed.where("n_shingles > 0 and doc_id is not null")
    own = F.struct("uid", "doc_id", "text_key")
    classes = able.groupBy("set_key").agg(
        F.min(own).alias("own"), F.min(F.struct("doc_id", "text_key")).alias("first"), F.any_value("n_shingles").alias("n"), F.any_value("bands").alias("bands"), F.any_value("sketch").alias("sketch")
    )
    classes = written(classes.select("set_key", F.col("own.uid").alias("rep"), "own.doc_id", "own.text_key", "first", "n", "bands", "sketch"), "classes")
    labels = _class_links(classes, _keyed(docs), _repeats(signed), width, percent, 2 * bands * perms_per_band, unit)
    grouped = written(_labelled(classes.select("set_key", "rep", "first"), labels, "rep", "root", "set_key"), "grouped")
    firsts = grouped.groupBy("root").agg(F.min("first").alias("first"))
    of_class = written(spread_join(grouped.select("set_key", "rep", "root"), firsts, "root", "rep").select("set_key", "first"), "of_class")
    discard(grouped)
    linked = spread_join(able.select("uid", "doc_id", "text_key", "n_shingles", "set_key"), of_class, "set_key", "uid")
    alone = signed.where("not (n_shingles > 0 and doc_id is not null)").select("doc_id", "text_key", "n_shingles", F.lit(None).cast(linked.schema["first"].dataType).alias("first"))
    return linked.select("doc_id", "text_key", "n_shingles", "first").unionByName(alone)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = 24, perms_per_band: int = 3, unit: int = 512) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs`` (doc_id, text).

    Documents are linked if 100 * common >= ``percent`` * united shingles. With 24 bands of 6 values
    a pair at 0.85 is missed with a probability of 1e-5, at 0.8 of 1e-3; more bands lower that.
    """
    placed = place(docs, width, percent, bands, perms_per_band, unit).select("doc_id", "n_shingles", F.coalesce("first.doc_id", "doc_id").alias("component_id"))
    return placed.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = 32, perms_per_band: int = 2) -> DataFrame:
    """``docs`` with one document of each group of near duplicates, all columns unchanged: that of the smallest id, then text key.

    With 32 bands of 4 values a pair at 0.8 is missed with a probability of 5e-8. A document is an
    id with a text: where an id has several texts, each is judged by itself, and of rows that
    repeat both one stays. Rows without id all stay. The texts are read again and joined with the
    ids to drop only, which are few next to those that stay.
    """
    placed = written(place(docs, width, percent, bands, perms_per_band), "placed")
    key = [F.col("__id"), F.col("__key")]
    drop = placed.where("first is not null and (first.doc_id <> doc_id or first.text_key <> text_key)").select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct()
    same = (F.col("doc_id").cast("long") == key[0]) & (F.xxhash64(F.col("text").cast("string")) == key[1])
    left = docs.join(drop, same, "left_anti")
    if not _repeats(placed):
        return left
    twice = placed.where("doc_id is not null").groupBy(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).count().where("count > 1").drop("count")
    return left.join(twice, same, "left_anti").unionByName(left.join(twice, same, "left_semi").dropDuplicates(["doc_id", "text"]))


def _repeats(rows: DataFrame) -> bool:
    """Whether some (doc_id, text_key) occurs twice."""
    return not rows.where("doc_id is not null").groupBy("doc_id", "text_key").count().where("count > 1").isEmpty()
