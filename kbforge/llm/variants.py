"""Grouping of spelling variants by pairs of trie nodes (operator 11).

Words are near if they differ by exactly one inserted, deleted or replaced code point. The nodes of
a trie of the words and of a trie of the reversed words are numbered. Leaving out position i of a
word gives the pair (node of what is before, node of what is behind): two words with an equal pair
differ in that letter at most, and a word whose cut at i gives the pair lacks it. So joining integer
pairs across skipped and cut positions gives the exact neighbours, and no string is compared.

Tries are numbered along sorted words, one range of words a task: a word keeps the nodes of the
letters that it shares with the word before. Where a range begins inside a subtree, its numbers are
later read as those of the range before; for that the driver sees two words a range. Nodes that
only one word passes can lead to no neighbour and make no pair.

A pair has at most one word a letter of the alphabet, and one whose cut it is. Its words are
counted, and their best taken, over the pair; links themselves are never rows. The form of a word
is its near word of largest count if that is at least twice its own, so counts at least double along
forms, and roots are found by following pointers for a logarithm of rounds.

Defined cases: null text has no words; texts and words of any length take steps in proportion;
repeated rows count each; rows without id count, but get no slips of the pen; an empty table gives no rows; further columns are
ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .minhash import spread_join
from .workspace import written

#: Letters stay (A-Z in lower case), all else becomes a blank; both in Latin-1.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))
#: Words that a task counts before it hands them on.
HELD = 1 << 18
#: A pair's word leaves out the position, or does so within a run of equal letters, or is cut there.
FIRST, WITHIN, CUT = 1, 0, 2


def slip(run: bytes, doc: int, every: int) -> bytes:
    """``run`` (Latin-1) without a letter if ``every`` divides the checksum of ``<doc_id>:<run>``."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), doc)
    return run if h % every else run[: (at := h % len(run))] + run[at + 1 :]


def word_counts(docs: DataFrame, slips: int | None = None, letters: int = 5, least: int = 3) -> DataFrame:
    """(word, n): runs of Latin letters of ``docs`` (doc_id, text), of at least ``letters`` code points and ``least`` occurrences.

    With ``slips`` a letter is left out of one in so many (document, run), by checksum.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def handed() -> pa.RecordBatch:
            words = [w.decode("latin-1") for w in held]
            out = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                runs = Counter((text.as_py() or "").encode("latin-1", "replace").translate(LETTERS).split())
                start = zlib.crc32(b"%d:" % doc) if slips and doc is not None else None
                for run, n in runs.items():
                    word = run if start is None else slip(run, start, slips)
                    if len(word) >= letters:
                        held[word] += n
                if len(held) >= HELD:
                    yield handed()
        if held:
            yield handed()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = rows.mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def common(x: str, y: str) -> int:
    """How many letters two words share from their beginning."""
    k, n = 0, min(len(x), len(y))
    while k < n and x[k] == y[k]:
        k += 1
    return k


def with_nodes(words: DataFrame, key: str, out: str) -> DataFrame:
    """``words`` sorted by ``key``, with ``out`` (the numbers of the trie nodes of its beginnings, as far as another word shares them), ``place`` (rising along the order) and ``edge`` (the row begins or ends a task's range; it has all its nodes)."""
    fields = words.schema.fields
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [f"{out} array<long>", "place long", "edge boolean"])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        node, place, path, last, shared = base, base, [0], None, 0

        def done(batch: pa.RecordBatch, following: str | None) -> pa.RecordBatch:
            nonlocal node, place, path, last, shared
            keys, nodes, edges = batch.column(key).to_pylist(), [], []
            for word, after in zip(keys, [*keys[1:], following]):
                path = path[: shared + 1] + list(range(node + 1, node + 1 + len(word) - shared))
                node += len(word) - shared
                ahead = 0 if after is None else common(word, after)
                edges.append(last is None or after is None)
                nodes.append(path if edges[-1] else path[: max(shared, ahead) + 1])
                last, shared = word, ahead
            places = pa.array(range(place, place + len(keys)), pa.int64())
            place += len(keys)
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(nodes, pa.list_(pa.int64())), places, pa.array(edges, pa.bool_())], [*batch.schema.names, out, "place", "edge"])

        held = None
        for batch in batches:
            if batch.num_rows:
                if held is not None:
                    yield done(held, batch.column(key)[0].as_py())
                held = batch
        if held is not None:
            yield done(held, None)

    return words.repartitionByRange(key).sortWithinPartitions(key).mapInArrow(number, schema)


def same_nodes(numbered: DataFrame, key: str, out: str) -> dict[int, int]:
    """Numbers that a range gave to nodes of the ranges before it, with those of the first such range: a few a range."""
    ends = numbered.where("edge").select("place", F.col(key).alias("word"), F.col(out).alias("nodes")).orderBy("place").collect()
    same: dict[int, int] = {}
    for before, row in zip(ends, ends[1:]):
        if before.place >> 40 != row.place >> 40:
            same.update(zip(row.nodes[1 : common(before.word, row.word) + 1], before.nodes[1:]))
    for node in same:  # the range before may have begun inside the same subtree
        while same[node] in same:
            same[node] = same[same[node]]
    return same


def node_pairs(numbered: DataFrame, same_fore: dict[int, int], same_back: dict[int, int]) -> DataFrame:
    """(fore, back, kind, id, n): the node pairs of the skipped and cut positions of words (id, n, word, fore, back)."""

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list[int]] = [[], [], [], [], []]
            names = ("id", "n", "word", "fore", "back")
            for own, n, word, fore, back in zip(*(batch.column(c).to_pylist() for c in names)):
                fore, back, length = [same_fore.get(x, x) for x in fore], [same_back.get(x, x) for x in back], len(word)
                skips = range(max(0, length - len(back)), min(length, len(fore)))
                cuts = range(max(0, length + 1 - len(back)), min(length + 1, len(fore)))
                columns[0] += [fore[i] for i in skips] + [fore[i] for i in cuts]
                columns[1] += [back[length - 1 - i] for i in skips] + [back[length - i] for i in cuts]
                columns[2] += [WITHIN if i and word[i] == word[i - 1] else FIRST for i in skips] + [CUT] * len(cuts)
                columns[3] += [own] * (len(skips) + len(cuts))
                columns[4] += [n] * (len(skips) + len(cuts))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["fore", "back", "kind", "id", "n"])

    return numbered.select("id", "n", "word", "fore", "back").mapInArrow(pair, "fore long, back long, kind int, id long, n long")


def near_words(pairs: DataFrame) -> DataFrame:
    """(id, n_near, best): how many words are near, and (n, -id) of the one of largest count, if that is above the word's own."""
    pair = Window.partitionBy("fore", "back")
    word = F.struct("n", (-F.col("id")).alias("back_id"))
    skipped, first, cut = F.col("kind") != CUT, F.col("kind") == FIRST, F.col("kind") == CUT
    over = lambda which: F.max(F.when(which, word)).over(pair)
    many = lambda which: F.count(F.when(which, 1)).over(pair)
    met = pairs.select("id", "kind", word.alias("own"), many(skipped).alias("skips"), many(first).alias("firsts"), many(cut).alias("cuts"), over(skipped).alias("skip"), over(first).alias("insert"), over(cut).alias("remove"))
    # A word that is the best of its own pair has no nearer one of larger count there.
    other = F.when(F.col("skip") != F.col("own"), F.col("skip"))
    links = met.select(
        "id",
        F.when(cut, F.col("firsts")).when(first, F.col("skips") - 1 + F.col("cuts")).otherwise(F.col("skips") - 1).alias("links"),
        F.when(cut, F.col("insert")).when(first, F.greatest(other, F.col("remove"))).otherwise(other).alias("best"),
    )
    return links.where("links > 0").groupBy("id").agg(F.sum("links").alias("n_near"), F.max("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(id, root): the end of the forms (id, form) that lead from each id."""
    at = written(forms.select("id", F.col("form").alias("root")), "roots")
    while True:
        step = at.select(F.col("id").alias("root"), F.col("root").alias("beyond"))
        further = spread_join(at, step, "root", "id")
        if further.isEmpty():
            return at
        moved = further.select("id", F.col("beyond").alias("root"))
        at = written(moved.unionByName(at.join(step, "root", "left_anti").select("id", "root")), "roots")


def group_variants(counts: DataFrame) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for each row of ``counts`` (word, n), words being distinct."""
    fore = written(with_nodes(counts.select("word", "n"), "word", "fore").withColumn("id", F.col("place")), "fore")
    same_fore = same_nodes(fore, "word", "fore")
    back = fore.drop("place", "edge").withColumn("reversed", F.reverse("word"))
    back = written(with_nodes(back, "reversed", "back"), "back")
    near = near_words(node_pairs(back, same_fore, same_nodes(back, "reversed", "back")))
    words = fore.select("id", "word", "n")
    found = words.join(near, "id", "left").select("id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.expr("if(best.n >= 2 * n, best, null)").alias("best"))
    found = written(found.select("id", "word", "n", "n_near", F.col("best.n").alias("form_n"), (-F.col("best.back_id")).alias("form")), "near")
    led = found.where("form is not null")
    named = lambda name: words.select(F.col("id").alias(f"{name}_id"), F.col("word").alias(name))
    ends = roots(led).withColumnRenamed("root", "root_id")
    led = spread_join(led.withColumnRenamed("form", "form_id"), named("form"), "form_id", "id").join(spread_join(ends, named("root"), "root_id", "id").select("id", "root"), "id")
    columns = ["word", "n", "n_near", "form", "form_n", "root"]
    alone = found.where("form is null").withColumn("root", F.col("word")).withColumn("form", F.lit(None).cast("string"))
    return led.select(*columns).unionByName(alone.select(*columns))
