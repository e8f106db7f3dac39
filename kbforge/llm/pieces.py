"""SentencePiece encoding and decoding for merge-type vocabularies (operator 13).

A text's symbols begin as single characters. An agenda holds the adjacent pairs of symbols that are
a piece together, highest score first and leftmost among equal scores; the best pair becomes one
symbol, its two new pairs join the agenda, and pairs whose symbols have meanwhile changed are
skipped. What is then no piece falls back to its UTF-8 bytes.

A vocabulary in which no piece holds a word mark behind another character never merges across the
beginning of a word, so a text is a sequence of words that are encoded one by one, and a word that
a worker has met before is looked up. Other vocabularies are encoded as whole texts.

The sentencepiece library normalises the texts and decodes the ids. In each Arrow batch it also
encodes every word that went through the agenda there, and a whole text; ids that differ from the
library's raise an error instead of giving wrong rows.

Defined cases: null text counts as empty, which has no ids and decodes to empty text; texts and
words of any length take an agenda of n log n steps; repeated rows and rows without id are encoded
each; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The mark that stands for a blank in pieces.
MARK = "▁"
WORDS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
#: Longer texts keep their agenda in a heap, and the place of a pair that is no piece.
SCANNED, NONE = 48, 1 << 62
#: Words up to that length that a worker remembers; it starts anew beyond, so its memory has a bound.
MEMO = 1 << 19
#: Characters of texts that are encoded and checked at once.
SLICE = 1 << 20


class MergeEncoder:
    """Ids of normalised text by merging the best adjacent pair until none is a piece."""

    def __init__(self, model):
        size = model.get_piece_size()
        plain = [k for k in range(size) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k))]
        if any(map(model.is_unused, plain)):
            raise ValueError("vocabularies with pieces that are switched off are not supported")
        self.ids = {model.id_to_piece(k): k for k in plain}
        scores = {piece: model.get_score(k) for piece, k in self.ids.items()}
        places = {score: k for k, score in enumerate(sorted(set(scores.values()), reverse=True))}  # equal scores, equal places
        self.rank = {piece: places[score] for piece, score in scores.items()}.get
        self.bytes = {int(model.id_to_piece(k)[3:5], 16): k for k in range(size) if model.is_byte(k)}
        self.unknown = model.unk_id()
        inside = any(MARK in piece.lstrip(MARK) for piece in self.ids)
        #: Whether words are encoded one by one: needs bytes to fall back to, and blanks that are kept.
        self.by_word = not inside and bool(self.bytes) and model.normalize("a  b ") == f"{MARK}a{MARK}{MARK}b{MARK}"
        self.memo: dict[str, tuple[int, ...]] = {}
        self.fresh: dict[str, tuple[int, ...]] = {}  # encoded since the last check

    def symbols(self, text: str) -> list[str]:
        """The symbols that are left when no adjacent pair is a piece."""
        return self._short(text) if len(text) <= SCANNED else self._long(text)

    def _short(self, text: str) -> list[str]:
        """The agenda of a word is a list with an entry a pair, and a scan finds the best: quicker than a heap of so few."""
        rank, parts = self.rank, list(text)
        agenda = [rank(p, NONE) for p in map(str.__add__, parts, text[1:])]
        while agenda and (best := min(agenda)) < NONE:
            k = agenda.index(best)
            parts[k] += parts.pop(k + 1)
            del agenda[k]
            if k < len(agenda):
                agenda[k] = rank(parts[k] + parts[k + 1], NONE)
            if k:
                agenda[k - 1] = rank(parts[k - 1] + parts[k], NONE)
        return parts

    def _long(self, text: str) -> list[str]:
        rank, parts, n = self.rank, list(text), len(text)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(r, k, p) for k, p in enumerate(map(str.__add__, parts, text[1:])) if (r := rank(p, NONE)) < NONE]
        heapq.heapify(agenda)
        while agenda:
            _, k, piece = heapq.heappop(agenda)
            right = after[k]
            if right >= n or not parts[k] or parts[k] + parts[right] != piece:
                continue  # one of the two has been merged since
            parts[k], parts[right] = piece, ""
            after[k] = following = after[right]
            if following < n:
                before[following] = k
                pair = piece + parts[following]
                if (r := rank(pair, NONE)) < NONE:
                    heapq.heappush(agenda, (r, k, pair))
            previous = before[k]
            if previous >= 0:
                pair = parts[previous] + piece
                if (r := rank(pair, NONE)) < NONE:
                    heapq.heappush(agenda, (r, previous, pair))
        return [p for p in parts if p]

    def merged(self, text: str) -> list[int]:
        found = []
        for part in self.symbols(text):
            if part in self.ids:
                found.append(self.ids[part])
            elif self.bytes:
                found += [self.bytes[b] for b in part.encode()]
            elif not found or found[-1] != self.unknown:  # characters in a row that are unknown are one id
                found.append(self.unknown)
        return found

    def encode(self, text: str) -> list[int]:
        """Ids of a normalised text."""
        if not self.by_word:
            return self.merged(text)
        memo, fresh, found = self.memo, self.fresh, []
        for word in WORDS.findall(text):
            ids = memo.get(word)
            if ids is None:
                ids = fresh[word] = tuple(self.merged(word))
                if len(word) <= SCANNED:
                    memo[word] = ids
            found.append(ids)
        return list(chain.from_iterable(found))

    def check(self, library, texts: list[str], ids: list[list[int]]) -> None:
        """Raises if the library encodes a text, or a word that is new since the last check, otherwise."""
        if self.by_word:  # the library puts the first mark itself
            self.fresh.pop(MARK, None)  # a blank at the end: nothing to merge, and no text of its own
            given, own = [w[1:].replace(MARK, " ") for w in self.fresh], [list(w) for w in self.fresh.values()]
            texts, ids = texts[:1] + given, ids[:1] + own
            self.fresh = {}
            if len(self.memo) > MEMO:
                self.memo.clear()
        if library.encode(texts, num_threads=1) != ids:
            raise ValueError("ids differ from the sentencepiece library's")


def _slices(texts: list[str]) -> Iterator[list[str]]:
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= SLICE:
            yield held
            held, size = [], 0
    if held:
        yield held


def encode_pieces(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, ids, decoded) for each row of ``docs`` (doc_id, text): its ids without begin or end, and the text that they decode to.

    The model file is of a fixed size.
    """
    with open(model_path, "rb") as f:
        model_bytes = docs.sparkSession.sparkContext.broadcast(f.read())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_proto=model_bytes.value)
        encoder = MergeEncoder(library)
        for batch in batches:
            at = 0
            for texts in _slices([t or "" for t in batch.column("text").to_pylist()]):
                ids = [encoder.encode(t) for t in library.normalize(texts)]
                encoder.check(library, texts, ids)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(at, len(texts)), pa.array(ids, pa.list_(pa.int32())), pa.array(library.decode(ids), pa.string())], ["doc_id", "ids", "decoded"]
                )
                at += len(texts)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(encode, "doc_id long, ids array<int>, decoded string")
