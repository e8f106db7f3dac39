"""Language identification by language-bitmask n-gram filters (operator 8).

A bit-sliced Bloom filter is a table of bitmasks, one bit for each language. An n-gram has several
slots; the intersection of their masks has the languages that hold it, all at once. The filter is
learned from the whole training part: n-grams are counted by language and slot within each task,
the counts are added up in Spark, and a language keeps its bit in a slot that reaches a minimum
share of its n-grams (so rare borrowings and junk do not fill the filter).

For a text, the popcount of language l over its n-grams is corrected by the rate of false
positives p_l (its share of set bits to the power of the number of slots):
(count - n p_l) / (1 - p_l). The largest decides; the score is its part of the sum.

The filter has a fixed number of slots, whatever the corpus, and one bit of each for every
language (4 MB for each 64 languages), so it may be broadcast.

Defined cases: null text, or one without letters, is ``und`` with score 0; with nothing learned
every text is ``und``; ties go to the language first by code point; a null lang teaches nothing;
repeated rows count as often as they occur; very long texts go by blocks of characters; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shingles import mix
from .split import held_out
from .workspace import discard, written

GRAM = 3
SLOT_BITS = 18
HASHES = 2
#: Characters of a text hashed at once: bounds memory for very long texts.
BLOCK = 1 << 18


def _letters() -> np.ndarray:
    """For each code point of the basic plane its lower-case form if it is a letter, else 0."""
    table = np.zeros(1 << 16, np.uint32)
    for c in range(1 << 16):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            table[c] = ord(low) if len(low) == 1 and ord(low) < 1 << 16 else c
    return table


LETTERS = _letters()


def _lowered(points: np.ndarray) -> np.ndarray:
    """Lower-case code points of letters, 0 for all else."""
    low = np.where(points < 1 << 16, LETTERS[points & 0xFFFF], 0).astype(np.uint64)
    far = points >= 1 << 16
    if far.any():
        low[far] = [p if chr(p).isalpha() else 0 for p in points[far].tolist()]
    return low


def slots(text: str) -> Iterator[tuple[bool, np.ndarray]]:
    """By blocks of the text: whether there are letters, and the slots (n-grams x HASHES) of its letter n-grams, words padded by a space."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    mask = np.uint64((1 << SLOT_BITS) - 1)
    for at in range(0, len(points), BLOCK):
        # each character of the block with its two neighbours
        low = np.pad(_lowered(points[max(at - 1, 0) : at + BLOCK + 1]), (int(at == 0), int(at + BLOCK >= len(points))))
        n = len(low) - GRAM + 1
        x, used = np.zeros(n, np.uint64), np.zeros(n, np.int8)
        for k in range(GRAM):
            x = x << np.uint64(21) | low[k : k + n]
            used += low[k : k + n] > 0
        x = mix(x[(used >= 2) & (low[1 : 1 + n] > 0)])  # a boundary at an end only
        yield bool(low[1:-1].any()), np.stack([((x >> np.uint64(SLOT_BITS * k)) & mask) + np.uint64(k << SLOT_BITS) for k in range(HASHES)], axis=1).astype(np.int64)


class LanguageFilter:
    """Bitmasks by slot, in words of 64 languages: masks[word, slot]; each hash has a part of the slots of its own."""

    def __init__(self, langs: list[str], masks: np.ndarray):
        self.langs, self.masks = langs, masks
        rates = []
        for k in range(len(langs)):
            bits = masks[k // 64].reshape(HASHES, -1) >> np.uint64(k % 64) & np.uint64(1)
            rates.append(float(np.prod(bits.mean(axis=1))))
        self.false_rate = np.array(rates)

    def counts(self, found: np.ndarray) -> np.ndarray:
        """How many of the n-grams each language holds."""
        parts = []
        for word in self.masks:
            held = word[found[:, 0]]
            for k in range(1, HASHES):
                held = held & word[found[:, k]]
            some = min(len(self.langs) - 64 * len(parts), 64)
            octets = held.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : -(-some // 8)]
            parts.append(np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)[:some])
        return np.concatenate(parts)

    def predict(self, text: str | None) -> tuple[str, float]:
        letters, n, count = False, 0, np.zeros(len(self.langs), np.int64)
        if self.langs:
            for some, found in slots(text or ""):
                letters |= some
                n += len(found)
                count += self.counts(found)
        if not letters:
            return "und", 0.0
        level = np.maximum((count - n * self.false_rate) / np.maximum(1 - self.false_rate, 1e-9), 0)
        best = int(level.argmax())
        return self.langs[best], float(level[best] / level.sum()) if level.sum() > 0 else 0.0


def learn(docs: DataFrame, min_share: float = 2e-5, held_langs: int = 32) -> LanguageFilter:
    """A filter from (doc_id, text, lang): all rows with a text and a lang that are not held out.

    A task keeps counts of every slot for the first ``held_langs`` languages that it meets. Slots of
    further ones wait together, and are counted by language whenever a filter's size of them has
    come, so any order of any number of languages is combined before the shuffle. The driver holds
    the list of languages and one bit of every slot for each.
    """
    rows = docs.where("text is not null and lang is not null").where(~held_out()).select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    size = HASHES << SLOT_BITS

    def counted(lang: str, at: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(n, pa.int64())], ["lang", "slot", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        further: dict[str, list[np.ndarray]] = defaultdict(list)
        waiting = 0
        for batch in batches:
            for text, lang in zip(batch.column("text"), batch.column("lang").to_pylist()):
                if lang not in totals and len(totals) < held_langs:
                    totals[lang] = np.zeros(size, np.int64)
                total = totals.get(lang)
                for _, found in slots(text.as_py()):
                    found = found.ravel().astype(np.int64)
                    if total is None:
                        further[lang].append(found)
                        waiting += len(found)
                    elif len(found) < size // 8:
                        np.add.at(total, found, 1)
                    else:
                        total += np.bincount(found, minlength=size)
                    if waiting >= size:
                        for of, parts in further.items():
                            yield counted(of, *np.unique(np.concatenate(parts), return_counts=True))
                        further.clear()
                        waiting = 0
        for of, parts in further.items():
            yield counted(of, *np.unique(np.concatenate(parts), return_counts=True))
        for lang, total in totals.items():
            at = np.flatnonzero(total)
            yield counted(lang, at, total[at])

    counts = rows.mapInArrow(count, "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    counts = written(counts, "counts")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("n_lang"))
    kept = counts.join(totals, "lang").where(F.col("n") * HASHES >= min_share * F.col("n_lang"))
    langs = sorted(r[0] for r in rows.select("lang").distinct().collect())
    masks = np.zeros((-(-len(langs) // 64), size), np.uint64)
    if langs:
        bits = docs.sparkSession.createDataFrame([(lang, k // 64, int(np.uint64(1 << k % 64).astype(np.int64))) for k, lang in enumerate(langs)], "lang string, word int, bit long")
        found = kept.join(bits, "lang").groupBy("word", "slot").agg(F.bit_or("bit").alias("mask")).toArrow()  # of the filter's size
        masks[found["word"].to_numpy(), found["slot"].to_numpy()] = found["mask"].to_numpy().astype(np.int64).view(np.uint64)
    discard(counts)
    return LanguageFilter(langs, masks)


def identify(docs: DataFrame, model: LanguageFilter) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every whole text of ``docs`` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.masks))  # of a fixed size

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = LanguageFilter(*shared.value)
        for batch in batches:
            found = [held.predict(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(predict, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
