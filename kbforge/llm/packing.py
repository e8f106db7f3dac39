"""Packing documents into training sequences by best-fit decreasing (operator 6).

Documents are tokenized, closed with an end id, and overlong ones cut into full windows. What is
left of each is placed, longest first, into the open window with the least room that still holds
it. A segment tree over the possible amounts of room finds that window in log2(window) steps.

Each task packs what it reads, in runs of ``run_tokens`` ids: no shuffle, bounded memory, and a
lost task packs the same again. A run leaves at most a few windows partly filled, which is a
vanishing share where a task reads millions of ids. So that it does, however many small files or
partitions the documents come in, partitions are read together by tasks of about ``task_bytes``
of text at least; a corpus of less is one task's.

Defined cases: null and empty texts are the end id alone; a very long text is cut into full windows
and what is left; pieces of one length are placed in the order of reading; repeated rows and rows
without id are packed as often as they occur; an empty table gives no rows; further columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import DocumentTokenizer

PIECES = "doc_id long, start long, length long, ids array<int>, doc_tokens long, sequence_id long, offset long"


class OpenWindows:
    """Open windows by the room they have left, with best-fit search."""

    def __init__(self, room: int):
        self.leaves = 1 << room.bit_length()
        self.any = bytearray(2 * self.leaves)  # any[i]: some window below node i of the tree
        self.by_room: list[list[int]] = [[] for _ in range(self.leaves)]

    def add(self, window: int, room: int) -> None:
        self.by_room[room].append(window)
        node = self.leaves + room
        while node and not self.any[node]:
            self.any[node] = 1
            node >>= 1

    def tightest(self, length: int) -> tuple[int, int] | None:
        """(window, room) with the least room of at least ``length``; the window is taken out."""
        node = self.leaves + length
        while not self.any[node]:
            while node & 1:  # a right child: what follows starts below an ancestor
                node >>= 1
            if not node:
                return None
            node += 1
        while node < self.leaves:
            node = 2 * node + (not self.any[2 * node])
        room = node - self.leaves
        window = self.by_room[room].pop()
        if not self.by_room[room]:
            while node:
                self.any[node] = 0
                node >>= 1
                if node and (self.any[2 * node] or self.any[2 * node + 1]):
                    break
        return window, room


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(window, offset) of each length in 1..window, and how many windows there are."""
    windows, offsets, count = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    opened = OpenWindows(window)
    for i in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[i])
        at, room = opened.tightest(length) or (count, window)
        count += at == count
        windows[i], offsets[i] = at, window - room
        if room > length:
            opened.add(at, room - length)
    return windows, offsets, count


def pack_documents(docs: DataFrame, tokenizer_path: str, window: int = 2048, end_id: int = 1, run_tokens: int = 1 << 22, task_bytes: int = 8 << 20) -> DataFrame:
    """One row for each piece of a document: its ids and its place in a sequence of at most ``window`` ids."""
    with open(tokenizer_path, encoding="utf-8") as f:
        vocabulary = docs.sparkSession.sparkContext.broadcast(f.read())  # of a fixed size

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = DocumentTokenizer(vocabulary.value)
        base, made = TaskContext.get().partitionId() << 33, 0
        run: list[tuple] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal made, run, size
            lengths = np.array([len(r[2]) for r in run], np.int64)
            at, offsets, count = best_fit_decreasing(lengths, window)
            for k in range(0, len(run), 2000):
                part = run[k : k + 2000]
                ends = np.cumsum([0, *(len(r[2]) for r in part)])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r[0] for r in part], pa.int64()),
                        pa.array([r[1] for r in part], pa.int64()),
                        pa.array(lengths[k : k + 2000]),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([r[2] for r in part]))),
                        pa.array([r[3] for r in part], pa.int64()),
                        pa.array(base + made + at[k : k + 2000]),
                        pa.array(offsets[k : k + 2000]),
                    ],
                    ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
                )
            made, run, size = made + count, [], 0

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = np.append(tokenizer.ids(text.as_py() or ""), np.int32(end_id))
                for start in range(0, len(ids), window):
                    run.append((doc_id, start, ids[start : start + window], len(ids)))
                size += len(ids)
                if size >= run_tokens:
                    yield from flush()
        if run:
            yield from flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("bytes")).first()["bytes"] or 0
    return rows.coalesce(max(1, size // task_bytes)).mapInArrow(pack, PIECES)
