"""Reversible redaction: placeholders numbered by document, and their restoration."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The patterns, in the order in which they are applied.
PATTERNS = [
    ("ID", r"\b[1-9]\d{5}(?:19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\d{3}[\dXx]\b"),
    ("CARD", r"\b\d{16,19}\b"),
    ("PHONE", r"\b1[3-9]\d{9}\b"),
    ("EMAIL", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"),
    ("AMOUNT", r"[¥￥]\d{1,3}(?:,\d{3})*(?:\.\d+)?(?:万?元)?|\b\d{1,3}(?:,\d{3})*(?:\.\d+)?(?:万元|元|人民币)"),
]
#: A placeholder as a model may give it back.
TOLERANT = re.compile(r"\[\s*\$\$\s*_\s*([A-Za-z]+)\s*_\s*(\d+)\s*\]")
PLACEHOLDER = re.compile(r"(\[\$\$_[A-Z]+_\d+\])")


def redact_one(text: str, words: Sequence[str]) -> tuple[str, dict[str, str]]:
    """The text with placeholders ``[$$_TYPE_n]``, and what they stand for. Placeholders are never searched again."""
    found: dict[str, str] = {}
    custom = [("TERM", re.escape(w)) for w in sorted(words, key=lambda w: (-len(w), w)) if len(w) >= 2]
    counts: dict[str, int] = {}
    taken = set(PLACEHOLDER.findall(text))  # what looks like a placeholder already stays unused
    for kind, pattern in [*PATTERNS, *custom]:
        parts = PLACEHOLDER.split(text)

        def put(match: re.Match, kind: str = kind) -> str:
            while True:
                counts[kind] = counts.get(kind, 0) + 1
                name = f"[$$_{kind}_{counts[kind]}]"
                if name not in taken:
                    break
            found[name] = match[0]
            return name

        text = "".join(p if k % 2 else re.sub(pattern, put, p) for k, p in enumerate(parts))
    return text, found


def redact_texts(docs: DataFrame, words: Sequence[str] = (), key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, safe_text, found) with the map from placeholder to original; numbering is a left-to-right fold, so it runs on Arrow batches."""
    kind = docs.schema[key].dataType.simpleString()

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            both = [redact_one(x or "", words) for x in frame[text]]
            yield pd.DataFrame({key: frame[key], "safe_text": [b[0] for b in both], "found": [b[1] for b in both]})

    return docs.select(key, text).mapInPandas(fold, f"{key} {kind}, safe_text string, found map<string,string>")


def restore_one(text: str, found: dict[str, str]) -> str:
    """``text`` with the placeholders of ``found`` filled in, in one pass; blanks inside them and their case do not matter. What is filled in is not searched again."""
    return TOLERANT.sub(lambda m: found.get(f"[$$_{m[1].upper()}_{m[2]}]", m[0]), text)


def restore(redacted: DataFrame) -> DataFrame:
    """``redacted`` with ``restored``: ``restore_one`` of its ``safe_text`` and ``found`` (null without text)."""
    names = redacted.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in redacted.schema) + ", restored string"

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(batch.column("safe_text").to_pylist(), batch.column("found").to_pylist())
            back = [None if text is None else restore_one(text, dict(found or ())) for text, found in both]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(back, pa.string())], [*names, "restored"])

    return redacted.mapInArrow(fill, schema)
