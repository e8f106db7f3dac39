"""Deduplication, incremental state and table maintenance over immutable tables."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import fresh_dir, stored
from .analytics import latest, running_total
from .cells import directions, fit_cells, in_cells, usable
from .retrieval import blocked, matrices
from .substrings import substring_hits


def classify_arrivals(arrivals: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``arrivals`` with ``state``: new, duplicate, orphan (known with no chunks, to be processed again) or repeat (not the first in its batch).

    ``existing`` has the keys and ``chunks``; ``arrivals`` the keys and an ``arrival`` number.
    """
    known = existing.groupBy(*keys).agg(F.max("chunks").alias("chunks"))
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("arrival"))
    found = arrivals.withColumn("nth", nth).join(known, list(keys), "left")
    state = F.when(F.col("chunks") > 0, "duplicate").when(F.col("nth") > 1, "repeat").when(F.col("chunks") == 0, "orphan").otherwise("new")
    return found.withColumn("state", state).drop("nth", "chunks")


def semantic_duplicates(vectors: DataFrame, least: float = 0.92, unit_numbers: int = 1 << 20, cells: int | None = None, most_scores: int = 1 << 20) -> DataFrame:
    """(project_id, keep, drop, similarity): pairs of a project's vectors over ``least``; the smaller id is kept.

    Exact. Vectors lie in cells around centres (``cells.fit_cells``). By the triangle inequality of
    angles a vector can be that near to a member of another cell only if its angle to the centre is at
    most the cell's radius and the angle of ``least`` together, so it visits only those cells, and of two
    cells only the one of smaller number. Vectors without clusters, which would visit most cells, share
    one. A project's part of a cell is dealt into blocks of about ``unit_numbers`` components, and each
    pair of blocks is compared inside a task, members with members and visitors, in strips of
    ``most_scores`` scores; the pairs over ``least`` leave it strip by strip.
    """
    rows = vectors.select("project_id", "vec_id", F.col("embedding").cast("array<double>").alias("v")).where("project_id is not null and vec_id is not null and v is not null")
    rows = stored(rows, "vectors")
    met = placed_in_cells(rows, least, cells)
    sizes = met.groupBy("project_id", "cell").agg(F.sum(F.size("v")).alias("numbers"))
    sizes = stored(sizes.withColumn("blocks", F.greatest(F.ceil(F.col("numbers") / unit_numbers), F.lit(1)).cast("int")), "sizes")
    sent = sizes.agg(F.sum(F.col("numbers") * F.col("blocks"))).first()[0] or 1
    dealt = met.join(sizes.drop("numbers"), ["project_id", "cell"]).withColumn("block", F.pmod(F.xxhash64("vec_id"), "blocks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("project_id", "cell", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "vec_id", "home", "v")
    dealt = dealt.repartition(min(1 << 12, math.ceil(8 * sent / unit_numbers)), "project_id", "cell", "i", "j")  # their work is more than their size
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("project_id", "vec_id")}
    schema = f"project_id {kinds['project_id']}, keep {kinds['vec_id']}, drop {kinds['vec_id']}, similarity double"
    names = ["project_id", "keep", "drop", "similarity"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))  # at most two blocks and their visitors
        table = table.take(pc.sort_indices(table["vec_id"]))
        ids, block, i, j = table["vec_id"].combine_chunks(), table["block"].to_numpy(), table["i"][0].as_py(), table["j"][0].as_py()
        home, project = table["home"].to_numpy(zero_copy_only=False), table["project_id"][0]
        for _, (at, m, gap, norm) in matrices(table["v"])[1].items():
            at = at[~gap & (norm > 0)]
            unit = m[~gap & (norm > 0)] / norm[~gap & (norm > 0)][:, None]
            member, first = home[at], block[at] == i
            # visitors meet members only
            sides = [(np.ones(len(at), bool), member)] if i == j else [(first, ~first & member), (~first & ~member, first & member)]
            for left, right in (map(np.flatnonzero, side) for side in sides):
                of = unit[right].T
                step = max(1, most_scores // max(len(right), 1))
                for begin in range(0, len(left) if len(right) else 0, step):  # pairs are handed on as they are found
                    dot = unit[left[begin : begin + step]] @ of
                    x, y = np.nonzero(dot > least - 1e-6)
                    worth = dot[x, y]
                    worth = np.copysign(np.floor(np.abs(worth) * 1e6 + 0.5) / 1e6, worth)
                    x, y = left[x + begin], right[y]
                    fine = (worth > least) & ((x < y) | ~member[x] | (i != j))
                    x, y, worth = x[fine], y[fine], worth[fine]
                    if len(x):
                        pair = [ids.take(pa.array(at[f(x, y)])) for f in (np.minimum, np.maximum)]
                        yield pa.RecordBatch.from_arrays([pa.repeat(project, len(x)), *pair, pa.array(worth)], names)

    return dealt.groupBy("project_id", "cell", "i", "j").applyInArrow(compare, schema)


def placed_in_cells(rows: DataFrame, least: float, cells: int | None = None) -> DataFrame:
    """``rows`` (project_id, vec_id, v) once in their own ``cell`` (``home``) and once in each further one that may hold a vector of a cosine above ``least``.

    Vectors without direction, or of another length than most, share a cell of their own. All others
    share one, too, if those of the sample would visit more than half of the cells and no number of
    ``cells`` is given: the copies would spare few comparisons.
    """
    centres, sample = fit_cells(rows.select("vec_id", F.col("v").alias("embedding")), cells or min(1024, max(1, math.isqrt(rows.count()))))
    alone = rows.withColumns({"cell": F.lit(-1), "home": F.lit(True)})
    if not len(centres):
        return alone
    # floor of the similarity's rounding to six places, and of the angles' own
    reach = math.acos(max(-1.0, min(1.0, least - 1e-6))) + 1e-6
    fine = usable(F.col("v"), centres.shape[1])
    if cells is None and visited_share(centres, sample, reach) > 0.5:
        return rows.withColumns({"cell": F.when(fine, 0).otherwise(-1), "home": F.lit(True)})
    owned = stored(in_cells(rows, "v", centres), "owned")
    shared = rows.sparkSession.sparkContext.broadcast(centres)  # of a chosen size

    def radii(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own = batch.column("cell").to_numpy()
                near = np.clip((directions(batch.column("v")) * shared.value[own]).sum(axis=1), -1, 1)
                yield pa.RecordBatch.from_arrays([batch.column("cell"), pa.array(np.arccos(near))], ["cell", "angle"])

    radius = np.zeros(len(centres))
    for r in owned.mapInArrow(radii, "cell int, angle double").groupBy("cell").agg(F.max("angle").alias("angle")).collect():  # a row a cell
        radius[r.cell] = r.angle
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return owned.mapInArrow(_visitor(shared, radius, reach), f"{kinds}, cell int, home boolean").unionByName(alone.where(~fine))


def visited_share(centres: np.ndarray, sample: np.ndarray, reach: float, asked: int = 512) -> float:
    """The share of cells that are within ``reach`` of ``asked`` vectors of the sample, by the radii that cells have in it."""
    radius, own = np.zeros(len(centres)), np.empty(len(sample), int)
    for begin in range(0, len(sample), asked):
        angle = np.arccos(np.clip(sample[begin : begin + asked] @ centres.T, -1, 1))
        own[begin : begin + asked] = angle.argmin(axis=1)
        np.maximum.at(radius, own[begin : begin + asked], angle.min(axis=1))
    some = sample[np.linspace(0, len(sample) - 1, min(asked, len(sample))).astype(int)]
    return float((np.arccos(np.clip(some @ centres.T, -1, 1)) <= reach + radius[None, :]).mean())


def _visitor(shared, radius: np.ndarray, reach: float, most_numbers: int = 1 << 21) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(project_id, vec_id, v, cell) for each cell that it visits, and its own, at most about ``most_numbers`` components at once."""

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = np.arange(len(radius))
        step = max(1, most_numbers // shared.value.size)
        for whole in batches:
            for begin in range(0, whole.num_rows, step):
                batch = whole.slice(begin, step)
                own = batch.column("cell").to_numpy()
                angles = np.arccos(np.clip(directions(batch.column("v")) @ shared.value.T, -1, 1))
                who, where = np.nonzero((number[None, :] == own[:, None]) | (number[None, :] < own[:, None]) & (angles <= reach + radius[None, :] + 1e-6))
                rows = batch.select(["project_id", "vec_id", "v"]).take(pa.array(who))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(where.astype(np.int32)), pa.array(own[who] == where)], ["project_id", "vec_id", "v", "cell", "home"])

    return visit


def retain_newest(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The newest ``n`` rows of each key."""
    return latest(rows, keys, order, n).drop("nth")


def substantive(turns: DataFrame, least: int = 5) -> DataFrame:
    """Conversations with at least ``least`` characters by the user."""
    chars = F.sum(F.when(F.col("role") == "user", F.char_length(F.trim("text"))).otherwise(0))
    return turns.groupBy("conv_id").agg(chars.alias("user_chars")).where(F.col("user_chars") >= least)


def conversation_titles(turns: DataFrame, length: int = 40, default: str = "New conversation") -> DataFrame:
    """(conv_id, title): the first user message that is not blank, without control characters, cut to ``length``."""
    title = F.trim(F.left(F.regexp_replace("text", r"[\x00-\x1f\x7f]", ""), F.lit(length)))
    usable = F.when((F.col("role") == "user") & (title != ""), F.struct("turn", title.alias("title")))
    return turns.groupBy("conv_id").agg(F.coalesce(F.min(usable)["title"], F.lit(default)).alias("title"))


def upsert(current: DataFrame, changes: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """Keyed upsert: the row of the highest ``version`` wins, changes before current rows on a tie."""
    both = current.withColumn("__new", F.lit(0)).unionByName(changes.withColumn("__new", F.lit(1)))
    return latest(both, keys, [F.col(version).desc(), F.col("__new").desc()]).drop("nth", "__new")


def drift(source: DataFrame, index: DataFrame, key: str, digest: str) -> DataFrame:
    """Keys in both tables whose digest differs."""
    return source.select(key, F.col(digest).alias("a")).join(index.select(key, F.col(digest).alias("b")), key).where("a <> b").select(key)


def normalise_items(items: DataFrame, default: str = "general") -> DataFrame:
    """Candidate items (item_id, category, description, flag, confidence): trimmed, defaulted, blank ones gone, first of equal ones kept, confidence within 0..1."""
    category = F.coalesce(F.nullif(F.trim("category"), F.lit("")), F.lit(default))
    rows = items.withColumn("category", category).withColumn("description", F.trim("description")).where("description <> ''")
    rows = rows.withColumn("__c", F.lower("category")).withColumn("__d", F.lower("description"))
    rows = latest(rows, ["__c", "__d", "flag"], [F.col("item_id")]).drop("nth", "__c", "__d")
    return rows.withColumn("confidence", F.greatest(F.least("confidence", F.lit(1.0)), F.lit(0.0)))


def treat_missing(rows: DataFrame, rules: Sequence[tuple[str, str, object]]) -> DataFrame:
    """``rows`` after steps (column, action, value): ``fill`` puts the value, ``mark`` adds ``<column>_missing``, ``drop`` removes rows; in order."""
    for column, action, value in rules:
        if action == "fill":
            rows = rows.withColumn(column, F.coalesce(F.col(column), F.lit(value)))
        elif action == "mark":
            rows = rows.withColumn(f"{column}_missing", F.col(column).isNull())
        elif action == "drop":
            rows = rows.where(F.col(column).isNotNull())
        else:
            raise ValueError(f"no such action: {action}")
    return rows


def missing_counts(rows: DataFrame, rules: Sequence[tuple[str, str, object]]) -> DataFrame:
    """(step, column, action, rows, missing) before each step of ``treat_missing``, in one pass over ``rows``."""
    alive, filled, parts = F.lit(True), set(), []
    for k, (column, action, _) in enumerate(rules):
        gone = F.lit(False) if column in filled else F.col(column).isNull()
        parts.append(F.struct(F.lit(k + 1).alias("step"), F.lit(column).alias("column"), F.lit(action).alias("action"), F.count_if(alive).alias("rows"), F.count_if(alive & gone).alias("missing")))
        if action == "drop":
            alive = alive & ~gone
        elif action == "fill":
            filled.add(column)
    return rows.agg(F.array(*parts).alias("steps")).select(F.inline("steps"))


def coverage(required: DataFrame, files: DataFrame, most: int = 4096) -> DataFrame:
    """(phase, name, required, status, path): each listed deliverable with the first file of its phase that fits, and files that no name lists.

    ``required`` is (phase, name, required), ``files`` (phase, path). A file fits if its path or its
    name without extension holds the deliverable's name, or the other way round. Without a file a
    required one is ``missing``, another ``optional``; with one it is ``pending``. Files whose name
    is not listed in their phase are ``optional``.
    """
    stem = F.regexp_replace(F.substring_index("path", "/", -1), r"(?<=.)\.[^.]*$", "")
    named = files.select("phase", "path", stem.alias("stem"))
    wanted = required.where("name <> ''").select(F.col("phase").alias("of"), "name", "required")
    fits = (F.col("phase") == F.col("of")) & (F.contains("path", F.col("name")) | F.contains("name", F.col("stem")) | F.contains("stem", F.col("name")))
    first = blocked(named, wanted, fits, most).groupBy("of", "name").agg(F.min("path").alias("path"))
    cells = wanted.join(first, ["of", "name"], "left")
    status = F.when(F.col("path").isNotNull(), "pending").when(F.col("required"), "missing").otherwise("optional")
    listed = cells.select(F.col("of").alias("phase"), "name", "required", status.alias("status"), "path")
    extra = files.withColumn("name", F.substring_index("path", "/", -1)).join(required.select("phase", "name").distinct(), ["phase", "name"], "left_anti")
    return listed.unionByName(extra.select("phase", "name", F.lit(False).alias("required"), F.lit("optional").alias("status"), "path"))


def sign_off(cells: DataFrame, events: DataFrame) -> DataFrame:
    """``cells`` (cell, phase, name, status) with the last sign-off of the completed ``events`` (event, phase, name, signed_off) that chose each.

    An event chooses the first cell whose phase and name fit: equal, or one phase holds the other;
    names equal with or without extension, or the cell's holds the event's, or the event's holds the
    cell's without extension. A cell once signed off is done. Which phases fit each other, and which
    names, is found over the distinct ones; only pairs of both that an event bears are joined.
    """
    stem = lambda c: F.regexp_replace(c, r"(?<=.)\.[^.]*$", "")
    asked = events.select("event", F.col("phase").alias("ep"), F.col("name").alias("en"), "signed_off")
    listed = stored(cells.groupBy("phase", "name").agg(F.min("cell").alias("cell")).withColumn("stem", stem("name")), "cells")
    borne = stored(asked.select("ep", "en").distinct().withColumn("stem", stem("en")), "borne")
    phases, wanted, names, stems, given = listed.select("phase").distinct(), borne.select("ep").distinct(), listed.select("name").distinct(), listed.select("stem", "name").distinct(), borne.select("en", "stem").distinct()
    holds = lambda texts, text, strings, string: substring_hits(texts.withColumn("within", F.col(text)), [text], ["within"], strings, F.col(string)).drop("within").withColumnRenamed("found", string)
    same_phase = holds(phases, "phase", wanted, "ep").unionByName(holds(wanted, "ep", phases, "phase")).distinct()
    same_name = holds(names, "name", given.select("en"), "en").unionByName(given.join(stems, "stem").select("name", "en"))
    same_name = same_name.unionByName(holds(given.select("en").distinct(), "en", stems, "stem").join(stems, "stem").select("name", "en")).distinct()
    fits = borne.select("ep", "en").join(same_phase, "ep").join(same_name, "en").join(listed, ["phase", "name"]).groupBy("ep", "en").agg(F.min("cell").alias("cell"))
    chosen = asked.join(fits, ["ep", "en"])
    last = chosen.groupBy("cell").agg(F.max_by("signed_off", "event").alias("signed_off"), F.bool_or("signed_off").alias("ever"))
    found = cells.join(last, "cell", "left")
    return found.select("cell", "phase", "name", F.when(F.col("ever"), "done").otherwise(F.col("status")).alias("status"), F.coalesce("signed_off", F.lit(False)).alias("signed_off"))


def classify_candidates(candidates: DataFrame, pages: DataFrame, ratio: Column, auto: float = 0.3) -> DataFrame:
    """(slug, status): pending for new or empty pages, auto up to ``auto`` change, else conflict."""
    found = candidates.join(pages, "slug", "left")
    status = F.when(F.col("content").isNull() | (F.trim("content") == ""), "pending").when(ratio <= auto, "auto").otherwise("conflict")
    return found.select("slug", status.alias("status"))


def phase_transition(phases: DataFrame, targets: DataFrame, today: Column) -> DataFrame:
    """Phases before a project's target completed, the target current, later ones reset."""
    at = F.col("phase_index")
    rows = phases.join(targets, "project_id")
    status = F.when(at < F.col("target"), "completed").when(at == F.col("target"), "current").otherwise("pending")
    return rows.withColumn("status", status).withColumn("started", F.when(at <= F.col("target"), F.coalesce("started", today))).withColumn("ended", F.when(at < F.col("target"), F.coalesce("ended", today))).drop("target")


def queue_state(log: DataFrame, retries: int = 3) -> DataFrame:
    """(item, project_id, state, position): the latest state of each item, failed ones with retries left pending again; pending ones in arrival order."""
    last = log.groupBy("project_id", "item").agg(F.max_by("state", F.struct("ts", "event_id")).alias("state"), F.count_if(F.col("state") == "failed").alias("failures"), F.min("ts").alias("first"))
    last = last.withColumn("state", F.when((F.col("state") == "failed") & (F.col("failures") < retries), "pending").otherwise(F.col("state")))
    last = running_total(last.withColumn("waits", (F.col("state") == "pending").cast("long")), ["project_id"], [F.col("first"), F.col("item")], "waits", "before")
    return last.select("project_id", "item", "state", F.when(F.col("state") == "pending", F.col("before") + 1).alias("position"))


def recent_title_duplicates(arrivals: DataFrame, listed: DataFrame, n: int = 3, keys: Sequence[str] = ("project_id",)) -> DataFrame:
    """``arrivals`` with ``duplicate``: whether the title equals one of the ``n`` documents at the end of the project's newest-first list.

    ``listed`` has the keys, ``title``, ``created`` and ``doc_id``.
    """
    last = latest(listed, keys, [F.col("created"), F.col("doc_id")], n).select(*keys, "title").distinct().withColumn("duplicate", F.lit(True))
    return arrivals.join(last, [*keys, "title"], "left").withColumn("duplicate", F.coalesce("duplicate", F.lit(False)))


def replace_vectors(current: DataFrame, changes: DataFrame, removed: DataFrame, key: str = "vec_id", version: str = "version") -> DataFrame:
    """Whole rows after a keyed replacement (the highest version of a key stays) and the removal of keys."""
    return upsert(current, changes, [key], version).join(removed.select(key).distinct(), key, "left_anti")


def append_versions(rows: DataFrame, existing: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """``rows`` with ``version``: from the highest existing one of their key on."""
    last = existing.groupBy(key).agg(F.max("version").alias("__last"))
    nth = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("__n", nth).join(last, key, "left").withColumn("version", (F.coalesce("__last", F.lit(0)) + F.col("__n")).cast("long")).drop("__n", "__last")


def sync_diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(action, old_id, new_id): nodes matched one to one by content and notes, then by content; the rest inserted or deleted."""

    def match(a: DataFrame, b: DataFrame, cols: list[str]) -> DataFrame:
        nth = lambda ident: F.row_number().over(Window.partitionBy(key, *cols).orderBy(ident))
        x = a.withColumn("nth", nth("old_id")).select("old_id", *[F.col(c).alias(f"x_{c}") for c in [key, "nth", *cols]])
        y = b.withColumn("nth", nth("new_id")).select("new_id", *[F.col(c).alias(f"y_{c}") for c in [key, "nth", *cols]])
        same = F.lit(True)
        for c in [key, "nth", *cols]:
            same = same & F.col(f"x_{c}").eqNullSafe(F.col(f"y_{c}"))
        return x.join(y, same).select("old_id", "new_id")

    exact = match(old, new, ["content", "notes"])
    old_rest, new_rest = old.join(exact, "old_id", "left_anti"), new.join(exact, "new_id", "left_anti")
    loose = match(old_rest, new_rest, ["content"])
    gone = old_rest.join(loose, "old_id", "left_anti").select(F.lit("delete").alias("action"), "old_id", F.lit(None).cast("long").alias("new_id"))
    added = new_rest.join(loose, "new_id", "left_anti").select(F.lit("insert").alias("action"), F.lit(None).cast("long").alias("old_id"), "new_id")
    kept = exact.select(F.lit("keep").alias("action"), "old_id", "new_id").unionByName(loose.select(F.lit("update").alias("action"), "old_id", "new_id"))
    return kept.unionByName(gone).unionByName(added)


def tree_levels(nodes: DataFrame) -> DataFrame:
    """(session_id, node_id, parent_id, depth) of an adjacency list, level by level until a level is empty.

    Levels are written to the shared folder, so the plan does not grow with the depth. Nodes whose
    parent is missing, and those below, have no level; a cycle raises.
    """
    nodes = stored(nodes, "nodes")
    ids = nodes.select("session_id", F.col("node_id").alias("parent_id"))
    rooted = _walk(nodes, nodes.where("parent_id is null"))
    if rooted.count() < nodes.count():
        lost = _walk(nodes, nodes.where("parent_id is not null").join(ids, ["session_id", "parent_id"], "left_anti"))
        if rooted.count() + lost.count() < nodes.count():
            raise ValueError("nodes on or below a cycle")
    return rooted


def _walk(nodes: DataFrame, start: DataFrame) -> DataFrame:
    """``start`` at depth 0 and all nodes below."""
    spark, base, depth, most = nodes.sparkSession, fresh_dir(nodes.sparkSession, "levels"), 0, nodes.count()
    schema = nodes.withColumn("depth", F.lit(0).cast("long")).schema
    level = start
    while True:
        path = f"{base}/{depth}"
        level.withColumn("depth", F.lit(depth).cast("long")).select(*schema.names).write.parquet(path)
        level = spark.read.schema(schema).parquet(path)
        if level.isEmpty():
            return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(base)
        if depth > most:
            raise ValueError("a node is its own ancestor")
        above = level.select("session_id", F.col("node_id").alias("parent_id"))
        level, depth = nodes.join(above, ["session_id", "parent_id"], "left_semi"), depth + 1
