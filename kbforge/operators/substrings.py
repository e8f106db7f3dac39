"""Substring joins: which of many strings each of many texts holds, in one pass over the texts.

A join on ``contains`` compares every text with every string. Here the distinct strings become one
automaton (a trie with failure links) that finds all of them while it reads a text once, so the
work is the texts' length plus the occurrences found. Strings of any number are taken in turns of a
bounded number of bytes; each turn's strings go to the tasks once, and the texts are never shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import stored

#: Bytes of strings in one automaton, with what each string costs besides.
TURN_BYTES, STRING_BYTES = 32 << 20, 64
#: Hits that a task gathers before it hands them on.
HELD = 1 << 16


def automaton(strings: Sequence[str]) -> ahocorasick.Automaton | None:
    """Finds the places in ``strings`` of all that a text holds; none without strings. The empty string is not among them."""
    made = ahocorasick.Automaton()
    for k, s in enumerate(strings):
        if s:
            made.add_word(s, k)
    if not len(made):
        return None
    made.make_automaton()
    return made


def substring_hits(texts: DataFrame, key: Sequence[str], columns: Sequence[str], strings: DataFrame, string: Column, turn_bytes: int = TURN_BYTES) -> DataFrame:
    """(key, found, a boolean for each of ``columns``): a row for each row of ``texts`` and distinct ``string`` of ``strings`` that one of its columns holds.

    As with ``contains``, a null holds nothing and is held by nothing, and any text holds the empty string.
    """
    spark = texts.sparkSession
    asked = stored(strings.select(string.alias("found")).where("found is not null").distinct(), "strings")
    size = asked.agg(F.sum(F.octet_length("found") + STRING_BYTES).alias("bytes")).first()["bytes"] or 0
    turns = max(1, math.ceil(size / turn_bytes))
    rows = texts.select(*key, *[F.col(c).alias(f"__text_{c}") for c in columns])
    schema = ", ".join([f"`{c}` {texts.schema[c].dataType.simpleString()}" for c in key] + ["found string"] + [f"`{c}` boolean" for c in columns])
    hits = None
    for turn in range(turns):
        block = asked.where(F.pmod(F.xxhash64("found"), F.lit(turns)) == turn).toArrow()["found"].combine_chunks()  # about ``turn_bytes``
        found = rows.mapInArrow(_finder(spark.sparkContext.broadcast(block), list(key), list(columns)), schema)
        hits = found if hits is None else hits.unionByName(found)
    return hits


def _finder(shared, key: list[str], columns: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings = pa.array(shared.value, pa.string())
        words = strings.to_pylist()
        made = automaton(words)
        empty = [k for k, s in enumerate(words) if not s]
        for batch in batches:
            at: list[int] = []
            which: list[int] = []
            held: list[list[bool]] = [[] for _ in columns]

            def handed(batch: pa.RecordBatch = batch) -> pa.RecordBatch:  # noqa: B023
                taken = batch.select(key).take(pa.array(at, pa.int64())) if key else None  # noqa: B023
                arrays = [*(taken.columns if key else []), strings.take(pa.array(which, pa.int64())), *(pa.array(h, pa.bool_()) for h in held)]  # noqa: B023
                return pa.RecordBatch.from_arrays(arrays, [*key, "found", *columns])

            for row, texts in enumerate(zip(*(batch.column(f"__text_{c}") for c in columns))):
                sets = []
                for text in texts:
                    text = text.as_py()
                    sets.append(set() if text is None else {k for _, k in made.iter(text)}.union(empty) if made else set(empty))
                every = set().union(*sets)
                which += every
                at += [row] * len(every)
                for h, s in zip(held, sets):
                    h += [k in s for k in every]
                if len(at) >= HELD:
                    yield handed()
                    at, which, held = [], [], [[] for _ in columns]
            yield handed()

    return find
