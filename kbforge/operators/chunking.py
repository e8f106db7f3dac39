"""Documents to chunks: sections, paragraph and sentence packing, windows, children, budgets."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Target, overlap share, small and large limits (bytes), child sizes (characters).
TARGET, OVERLAP, SMALL, LARGE = 800, 0.15, 160, 2400
PARENT_MIN, CHILD_SIZE, CHILD_MIN, CHILDREN = 200, 300, 100, 3
ENDERS = "。！？；.!?;\n"


def outline_rows(lines: DataFrame, keys: Sequence[str], order: str, line: str) -> DataFrame:
    """Numbered outline lines (``1 ``, ``1.1 ``, ``1.1.1 ``) as question rows with their section and category carried down."""
    level = F.size(F.split(F.regexp_extract(line, r"^(\d+(?:\.\d+){0,2}) ", 1), r"\."))
    rows = lines.where(F.col(line).rlike(r"^\d+(?:\.\d+){0,2} ")).withColumn("level", level).withColumn("title", F.trim(F.regexp_replace(line, r"^\d+(?:\.\d+){0,2} ", "")))
    down = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    carried = rows.withColumn("section_no", F.last(F.when(F.col("level") == 1, F.col(order)), True).over(down))
    carried = carried.withColumn("section", F.last(F.when(F.col("level") == 1, F.col("title")), True).over(down))
    within = Window.partitionBy(*keys, "section_no").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    carried = carried.withColumn("category", F.last(F.when(F.col("level") == 2, F.col("title")), True).over(within))
    questions = carried.where("level = 3")
    running = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return questions.select(*keys, running.cast("long").alias("ordinal"), "section", "category", F.col("title").alias("question"))


def sections(docs: DataFrame, key: str = "doc_id", text: str = "text", marker: str = "## ") -> DataFrame:
    """(key, section_no, heading, start, content): cut at ``marker`` lines; text before the first has no heading, empty sections go."""
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    before = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    is_heading = F.startswith(F.col("line"), F.lit(marker))
    lines = lines.withColumn("section_no", F.sum(is_heading.cast("long")).over(upto)).withColumn("at", F.coalesce(F.sum(F.char_length("line") + 1).over(before), F.lit(0)).cast("long"))
    part = F.struct("line_no", F.when(~is_heading, F.col("line")).alias("line"))
    whole = lines.groupBy(key, "section_no").agg(
        F.max(F.when(is_heading, F.trim(F.substring("line", len(marker) + 1, 2**31 - 1)))).alias("heading"), F.min("at").alias("start"), F.array_sort(F.collect_list(part)).alias("parts")
    )
    content = F.trim(F.array_join("parts.line", "\n"), F.lit(" \n"))
    return whole.select(key, "section_no", "heading", "start", content.alias("content")).where("content <> ''")


def windows(docs: DataFrame, size: int = 16000, overlap: int = 1600, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, window_no, content): fixed windows of characters that overlap; the last ends with the text."""
    step = size - overlap
    count = F.greatest(F.ceil((F.char_length(text) - overlap) / step), F.lit(1)).cast("int")
    rows = docs.where(F.char_length(text) > 0).select(key, text, F.explode(F.sequence(F.lit(0), count - 1)).alias("window_no"))
    return rows.select(key, F.col("window_no").cast("long").alias("window_no"), F.substring(F.col(text), F.col("window_no") * step + 1, F.lit(size)).alias("content"))


def size_of(text: str) -> int:
    return len(text.encode())


def _greedy(pieces: Iterable[str], target: int) -> list[str]:
    """Pieces, greedily joined up to ``target`` bytes."""
    out, size = [[]], 0
    for p in pieces:
        n = size_of(p)
        if size and size + n > target:
            out.append([])
            size = 0
        out[-1].append(p)
        size += n
    return ["".join(x) for x in out]


def pack_sentences(text: str, target: int = TARGET) -> list[str]:
    """Sentences, greedily joined up to ``target`` bytes."""
    return [x.strip() for x in _greedy(re.findall(rf"[^{ENDERS}]*[{ENDERS}]|[^{ENDERS}]+", text), target) if x.strip()]


def pack_paragraphs(text: str, target: int = TARGET, overlap: float = OVERLAP) -> list[str]:
    """Paragraphs, greedily joined; a chunk opens with the tail of the one before, except after a paragraph that had to be cut."""
    out, parts, size = [], [], 0  # the open chunk's lines and their bytes, with line feeds

    def open_with(*lines: str) -> None:
        nonlocal parts, size
        parts, size = list(lines), sum(map(size_of, lines)) + max(len(lines) - 1, 0)

    for p in filter(None, (x.strip() for x in text.split("\n"))):
        n = size_of(p)
        if n > target:
            if parts:
                out.append("\n".join(parts))
            out += pack_sentences(p, target)
            open_with()
        elif parts and size + 1 + n > target:
            whole = "\n".join(parts)
            out.append(whole)
            cut = int(len(whole) * overlap)
            open_with(*([whole[-cut:]] if cut else []), p)
        else:
            size += n + (1 if parts else 0)
            parts.append(p)
    return [*out, "\n".join(parts)] if parts else out


def level_sizes(chunks: list[str], small: int = SMALL, large: int = LARGE) -> list[str]:
    """Small chunks join the next one, else the one before, while that stays within ``large``; larger ones are cut at sentences."""
    out: list[str] = []
    for c in chunks:
        if out and (size_of(out[-1]) < small or size_of(c) < small) and size_of(out[-1]) + 1 + size_of(c) <= large:
            out[-1] = f"{out[-1]}\n{c}"
        else:
            out.append(c)
    return [x for c in out for x in (pack_sentences(c, large) if size_of(c) > large else [c])]


def children_of(chunk: str) -> list[str]:
    """Up to three child texts of about 300 characters, for parents of at least 200 with two sentences."""
    if len(chunk) < PARENT_MIN or sum(c in ENDERS for c in chunk) < 2:
        return []
    parts = pack_sentences(chunk, CHILD_SIZE)
    return [p for p in parts if len(p) >= CHILD_MIN][:CHILDREN]


def chunk_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", children: bool = True, carried: Sequence[str] = ()) -> DataFrame:
    """(key, carried, chunk_no, child_no, content): packed and levelled chunks, with their children below (child_no from 1; 0 is the chunk) and the document's ``carried`` columns."""
    kept = [key, *carried]
    kinds = "".join(f"{c} {docs.schema[c].dataType.simpleString()}, " for c in kept)
    names = [*kept, "chunk_no", "child_no", "content"]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, numbers, kids, contents = [], [], [], []

            def rows() -> pa.RecordBatch:
                columns = [batch.column(c).take(pa.array(at, pa.int64())) for c in kept]
                return pa.RecordBatch.from_arrays([*columns, pa.array(numbers, pa.int64()), pa.array(kids, pa.int64()), pa.array(contents, pa.string())], names)

            for row, x in enumerate(batch.column(text).to_pylist()):
                for n, c in enumerate(level_sizes(pack_paragraphs(x or ""))):
                    below = children_of(c) if children else []
                    at += [row] * (1 + len(below))
                    numbers += [n] * (1 + len(below))
                    kids += range(1 + len(below))
                    contents += [c, *below]
                if len(at) >= 1 << 14:
                    yield rows()
                    at, numbers, kids, contents = [], [], [], []
            yield rows()

    return docs.select(*kept, text).mapInArrow(fold, f"{kinds}chunk_no long, child_no long, content string")


def budget_batches(chunks: DataFrame, budget: int, key: str = "document_id", order: str = "line_no", content: str = "content", weight: str = "tokens") -> DataFrame:
    """``chunks`` with ``batch_no``: pieces in order, greedily packed so that a batch's ``weight`` stays within ``budget``.

    Pieces over the budget get a batch of their own (cut them before). The fold depends on the
    order, so pieces stream through a task sorted by document; its state is two numbers, whatever
    a document's length.
    """
    columns = [key, order, content, weight]
    ordered = chunks.select(*columns).repartition(key).sortWithinPartitions(key, order)
    schema = ", ".join(f"{c} {ordered.schema[c].dataType.simpleString()}" for c in columns) + ", batch_no long"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, used, number = None, 0, 0
        for batch in batches:
            numbers = []
            for k, w in zip(batch.column(key).to_pylist(), batch.column(weight).to_pylist()):
                if k != at:
                    at, used, number = k, 0, 0
                if used > 0 and used + w > budget:
                    used, number = 0, number + 1
                used += w
                numbers.append(number)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int64())], [*columns, "batch_no"])

    return ordered.mapInArrow(place, schema)


def merge_partials(partials: DataFrame, key: str, order: str, values: str) -> DataFrame:
    """(key, merged): the union of the windows' value lists, trimmed, without blanks, in order of first sight."""
    each = partials.select(key, order, F.posexplode(values).alias("i", "v")).withColumn("v", F.trim("v")).where("v <> ''")
    first = each.groupBy(key, "v").agg(F.min(F.struct(order, "i")).alias("at"))
    return first.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias("all")).select(key, F.col("all.v").alias("merged"))


def headings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_no, level, heading) of lines with one to six ``#`` and a blank before their words."""
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line")).where(F.col("line").rlike(r"^#{1,6} +[^ ]"))
    return lines.select(key, F.col("line_no").cast("long").alias("line_no"), F.length(F.regexp_extract("line", "^(#+)", 1)).cast("long").alias("level"), F.trim(F.regexp_extract("line", "^#+ +(.*)$", 1)).alias("heading"))


def heading_tree(headings: DataFrame, key: str = "doc_id", order: str = "line_no", level: str = "level") -> DataFrame:
    """``headings`` with ``parent``: the nearest earlier heading of a lower level (null at the top)."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    last_below = [F.max(F.when(F.col(level) < k, F.col(order))).over(before) for k in range(2, 7)]
    parent = F.lit(None).cast("long")
    for k, found in zip(range(2, 7), last_below):
        parent = F.when(F.col(level) == k, found).otherwise(parent)
    return headings.withColumn("parent", parent.cast("long"))
