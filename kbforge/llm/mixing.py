"""Mixing sources to target weights by weighted fair queueing (operator 9).

A source's documents queue in a shuffled order (a hash of id and seed, so reruns agree), and queue
again for each further pass, up to the cap. A document's virtual finish time is the number of words
that its source has then sent, divided by the source's target; ordered by it, every prefix of the
mix has all sources in proportion. The mix is sorted globally by virtual finish and truncated at
the total budget: that order alone decides what is taken. A document longer than 1 / ``grain`` of
its source's words queues in parts of that length, each with its own finish, so that a long one
does not hold its source back; as in fair queueing, only parts that a server working on all sources
at once would have begun by the end are eligible. So a source differs from its target by less than
a part: one word where a source has at most ``grain`` words, 1 / ``grain`` of it else. Parts of a
document are taken from its beginning, and at most one document a source in part.

Running totals, within a source and over the mix, go by blocks of the shuffle hash and of virtual
time, so a source that holds a third of all rows is spread over tasks like any other.

Defined cases: null text has size 0, a null source is one source after all others; documents of
size 0 are never in the mix; repeated rows queue as often as they occur; rows that tie in their
hash agree in id and text; texts of any length count by one pass; an empty table or one without
words gives an empty mix; further columns are carried by ``mixed_documents`` and ignored else.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .running import blocked_running_sum
from .workspace import written

WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target, budget) from (source, size): ``share`` of all words by weight, at most ``most`` times a source.

    Sources take ``weights`` in turn, ordered by code point with null last. The target is
    min(most * source_size, level * weight); sources reach their cap in the order of
    cap / weight, so the level follows from running sums over the sources in that order. The
    number of sources bounds this step, not that of documents.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    one = "partition by 1 order by"
    rank = f"row_number() over ({one} source asc nulls last) - 1"
    by_turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.expr(rank) % len(weights) + 1).cast("int"))
    order = f"({one} ratio, source asc nulls last rows between unbounded preceding and 1 preceding)"
    found = (
        totals.withColumn("weight", by_turn)
        .withColumn("ratio", F.col("source_size") * most / F.col("weight"))
        .withColumn("full", F.expr(f"coalesce(sum(source_size * {most}D) over {order}, 0D)"))
        .withColumn("open", F.expr(f"sum(weight) over (partition by 1) - coalesce(sum(weight) over {order}, 0D)"))
        .withColumn("budget", F.expr(f"sum(source_size) over (partition by 1) * {share}D"))
        # the level if just the sources before this one are at their caps; true for the first that stays below
        .withColumn("level", F.expr("case when (budget - full) / open <= ratio then (budget - full) / open end"))
        .withColumn("level", F.expr("(min(case when level is not null then struct(ratio, level) end) over (partition by 1)).level"))
    )
    target = F.least(F.col("source_size") * F.lit(most), F.coalesce(F.col("level") * F.col("weight"), F.col("source_size") * F.lit(most)))
    return found.select("source", "source_size", target.alias("target"), F.ceil("budget").alias("budget"))


def _key(seed: int) -> Column:
    """The shuffle hash: of id and text, so that only rows that agree in both share it."""
    return F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string")))


def queue(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 7, blocks: int = 8192) -> DataFrame:
    """Each document (without its text) with its size, its source's size and target, and where its words start in the source's queue."""
    text = F.col("text").cast("string")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        _key(seed).alias("shuffle"),
    )
    rows = written(rows.withColumn("block", F.floor((F.col("shuffle") / F.lit(2.0**64) + 0.5) * blocks).cast("int")), "sized")
    targets = source_targets(rows, weights, share, most).withColumnRenamed("source", "__of")
    rows = blocked_running_sum(rows, ["source"], "block", [F.col("shuffle"), F.col("doc_id"), F.col("size")], "size", "start")
    return rows.join(targets, F.col("source").eqNullSafe(F.col("__of"))).drop("__of", "block")


def mix_sources(queued: DataFrame, most: float = 2.0, blocks: int = 8192, grain: int = 16384) -> DataFrame:
    """The mix: a row for each time a document of ``queued`` is taken, with ``copy``, ``taken`` words and ``virtual_finish``.

    Rows are range-partitioned and sorted by virtual finish time. ``before`` counts the words of
    the mix that precede a row.
    """
    passes = F.explode(F.sequence(F.lit(0), F.lit(int(-(-most // 1)) - 1)))
    copies = queued.where("size > 0 and target > 0").withColumn("copy", passes)
    copies = copies.withColumn("queued_at", F.col("start") + F.col("copy") * F.col("source_size")).where("queued_at < target")
    quantum = F.ceil(F.col("source_size") / grain)
    parts = (
        copies.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, quantum)))
        .withColumn("sent", F.col("queued_at") + F.col("at"))
        .withColumn("words", F.least(quantum, F.col("size") - F.col("at"), F.floor(F.col("source_size") * F.lit(most)) - F.col("sent")))
        .where("sent < target and words > 0")
        .withColumn("virtual_finish", (F.col("sent") + F.col("words")) / F.col("target"))
        .withColumn("block", F.floor(F.col("virtual_finish") * blocks).cast("int"))
    )
    parts = blocked_running_sum(parts, [], "block", [F.col("virtual_finish"), F.col("source").asc_nulls_last(), F.col("sent")], "words", "before")
    parts = parts.where("before < budget").withColumn("taken", F.least(F.col("words"), F.col("budget") - F.col("before")))
    mix = parts.groupBy(*queued.columns, "copy", "queued_at").agg(F.sum("taken").alias("taken"), F.max("virtual_finish").alias("virtual_finish"), F.min("before").alias("before"))
    order = [F.col("virtual_finish"), F.col("source").asc_nulls_last(), F.col("queued_at")]
    return mix.repartitionByRange(*order).sortWithinPartitions(*order)


def mixed_documents(docs: DataFrame, mix: DataFrame, seed: int = 7, in_order: bool = False) -> DataFrame:
    """The documents of ``mix``, as often as it takes them, with all columns of ``docs``; texts taken in part are cut behind the last word taken, their spacing stays.

    Texts are shuffled once, to meet the narrow rows of the mix; ``in_order`` also sorts them by
    virtual finish time. Rows that agree in id and text are interchangeable, so one stands for all.
    """
    keyed = docs.withColumns({"__id": F.col("doc_id").cast("long"), "__key": _key(seed)})
    if not keyed.groupBy("__id", "__key").count().where("count > 1").isEmpty():  # ids and hashes only
        keyed = keyed.dropDuplicates(["__id", "__key"])
    rows = mix.select(F.col("doc_id").alias("__mix_id"), F.col("shuffle").alias("__mix_key"), F.col("taken").alias("__taken"), F.col("size").alias("__size"), F.col("virtual_finish").alias("__finish"))
    found = rows.join(keyed, F.col("__id").eqNullSafe(F.col("__mix_id")) & (F.col("__key") == F.col("__mix_key")))
    text = F.col("text").cast("string")
    pieces = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")  # each word with the spacing before it
    prefix = F.array_join(F.slice(pieces, 1, F.col("__taken").cast("int")), "")
    found = found.withColumn("text", F.when(F.col("__taken") < F.col("__size"), prefix).otherwise(text))
    if in_order:
        found = found.repartitionByRange("__finish", "__mix_id").sortWithinPartitions("__finish", "__mix_id")
    return found.select(docs.columns)


def words_taken(queued: DataFrame, mix: DataFrame) -> DataFrame:
    """``queued`` with ``taken``: the words that ``mix`` takes from each document, repeats counted."""
    row = ["doc_id", "source", "size", "source_size", "target", "start"]
    none = queued.select(*row, F.lit(0).cast("long").alias("taken"))
    some = none.where("size > 0").unionByName(mix.select(*row, "taken"))  # a start with words is one document's
    return some.groupBy(*row).agg(F.sum("taken").alias("taken")).unionByName(none.where("size = 0"))
