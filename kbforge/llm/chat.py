"""Chat rendering after collapsing cumulative snapshots (operator 2), in DataFrame functions only.

Logs often hold a conversation many times, each time a turn longer. Every turn gets a digest of
role and text, and two hashes of its position and digest; the running exclusive or of these over a
conversation is the hash of the prefix that ends there (128 bits). A conversation whose last prefix
hash is an inner prefix hash of another is dropped by an anti-join, equal ones keep the smallest
id; what is left is rendered.

All this runs on narrow rows (an id, a position, hashes). Texts are read for their digests, and
once more to be rendered: only then are they shuffled, once, by conversation. Prefix hashes are
made distinct before they are joined, so thousands of copies of one conversation meet as one row.
A conversation is one row of the result (Spark holds at most 2 GB in it), so its narrow rows are
bounded by that; they are sorted by one task, which spills.

Defined cases: turns are ordered by turn, nulls first; rows that tie in it by the digest of role
and text; repeated turn rows of a conversation are turns of their own; a null role renders as
``unknown``, a null text as empty; rows without conv_id are no conversation and are left out; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workspace import written


def _digest() -> Column:
    """16 bytes of role and text; null and empty differ."""
    whole = lambda c: F.coalesce(F.md5(F.col(c)), F.lit(""))
    return F.unhex(F.md5(F.concat(whole("role"), F.lit("|"), whole("text"))))


def _plain(turns: DataFrame) -> DataFrame:
    kinds = {"conv_id": "long", "turn": "long", "role": "string", "text": "string"}
    return turns.where("conv_id is not null").select(*[F.col(c).cast(kind).alias(c) for c, kind in kinds.items()])


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """(conv_id, n, h1, h2, last): hashes of the prefix of ``n`` turns, for each turn, and whether it is the whole conversation."""
    rows = _plain(turns).select("conv_id", "turn", _digest().alias("digest"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "digest")
    rows = rows.withColumn("n", F.row_number().over(order).cast("long"))
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    hashed = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), "n", "digest")).over(upto)
    return rows.select("conv_id", "n", hashed(1).alias("h1"), hashed(2).alias("h2"), F.lead("n").over(order).isNull().alias("last"))


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id) of the conversations that are no prefix of a longer one; of equal ones the smallest id."""
    hashed = written(prefix_hashes(turns), "prefixes")
    key = ["h1", "h2", "n"]
    ends = hashed.where("last").groupBy(*key).agg(F.min("conv_id").alias("conv_id"))
    inner = hashed.where("not last").select(*key).distinct()
    return ends.join(inner, key, "left_anti").select("conv_id")


def render_chat(turns: DataFrame, opening: str = "<|im_start|>", closing: str = "<|im_end|>") -> DataFrame:
    """(conv_id, n_turns, rendered) of each maximal conversation of ``turns`` (conv_id, turn, role, text)."""
    part = F.concat(F.lit(opening), F.coalesce("role", F.lit("unknown")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(closing))
    kept = _plain(turns).join(maximal_conversations(turns), "conv_id", "left_semi")
    whole = kept.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", _digest().alias("digest"), part.alias("part")))).alias("turns"))
    return whole.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.array_join("turns.part", "\n").alias("rendered"))
