"""Token counts by a linear longest-match automaton (operator 3).

Greedy longest-match word pieces of a word need not be built to be counted. The vocabulary is a
trie over bytes; a node that is no piece, and any node where the trie ends, falls back along a
failure link to the node that holds what is left after popping the pieces that are then certain.
Links and the numbers of popped pieces are precomputed, so a word takes one step a byte.

Every single byte is a piece of a byte-level vocabulary, so each word has pieces and the count is
defined for any text. A word is ``[^\\x20\\x09-\\x0D]+`` with one leading space (a marker that the
vocabulary has), so words do not depend on their neighbours.

Defined cases: null text counts as empty, 0 words and 0 tokens; very long texts and words take one
step a byte; repeated rows are counted each, rows without id too; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words whose count a worker remembers; it starts anew beyond, so its memory has a bound.
MEMO = 1 << 19


def byte_level_pieces(tokenizer_json: str) -> list[bytes]:
    """The pieces of a byte-level vocabulary, as bytes. Printable Latin-1 bytes stand for
    themselves there; the others, in order, for the code points from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(own)]
    byte = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(other)}
    model = json.loads(tokenizer_json)
    special = {t["content"] for t in model.get("added_tokens", [])}
    return [bytes(byte[c] for c in piece) for piece in model["model"]["vocab"] if piece not in special]


class LongestMatch:
    """Counts the greedy longest-match pieces of byte strings in linear time.

    ``pieces`` must hold every byte that occurs as a piece of its own.
    """

    def __init__(self, pieces: list[bytes]):
        step: dict[int, int] = {}  # node << 8 | byte -> node
        final, parent = [False], [(0, 0)]
        for piece in pieces:
            node = 0
            for c in piece:
                node, at = step.get(node << 8 | c, -1), node
                if node < 0:
                    node = step[at << 8 | c] = len(final)
                    final.append(False)
                    parent.append((at, c))
            final[node] = node > 0
        depth = [0] * len(final)
        for v in range(1, len(final)):  # parents come first
            depth[v] = depth[parent[v][0]] + 1
        link, popped = [-1] * len(final), [0] * len(final)
        for v in sorted(range(1, len(final)), key=depth.__getitem__):
            if final[v]:
                link[v], popped[v] = 0, 1
                continue
            u, c = parent[v]
            z, n = link[u], popped[u]
            while z >= 0 and (to := step.get(z << 8 | c, -1)) < 0:
                n += popped[z]
                z = link[z]
            link[v], popped[v] = (to, n) if z >= 0 else (-1, n)
        self.step, self.link, self.popped = step, link, popped

    def count(self, word: bytes) -> int:
        step, link, popped, node, n = self.step, self.link, self.popped, 0, 0
        for c in word:
            while (to := step.get(node << 8 | c, -1)) < 0:
                n += popped[node]
                node = link[node]
                if node < 0:
                    raise ValueError(f"byte {c} is no piece")
            node = to
        while node:
            n += popped[node]
            node = link[node]
        return n


def token_counts(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, n_words, n_tokens) for each row of ``docs`` (doc_id, text); the vocabulary file is of a fixed size."""
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        vocabulary = spark.sparkContext.broadcast(f.read())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = LongestMatch(byte_level_pieces(vocabulary.value))
        memo: dict[bytes, int] = {}
        for batch in batches:
            words, tokens = [], []
            for text in batch.column("text"):
                parts = (text.as_py() or "").encode().split()
                total = 0
                for w in parts:
                    n = memo.get(w)
                    if n is None:
                        if len(memo) >= MEMO:
                            memo.clear()
                        n = automaton.count(b" " + w)
                        if len(w) < 64:
                            memo[w] = n
                    total += n
                words.append(len(parts))
                tokens.append(total)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_words", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(count, "doc_id long, n_words long, n_tokens long")
