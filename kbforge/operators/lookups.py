"""Joins of the knowledge base: scope, exclusion, parents, suggestions, work lists, caches, meetings, registers, listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .analytics import latest
from .graph import extract_links
from .substrings import substring_hits


def without_documents(chunks: DataFrame, excluded: DataFrame, key: str = "document_id") -> DataFrame:
    """``chunks`` of documents that ``excluded`` does not name (attachments, deleted ones)."""
    return chunks.join(excluded.select(key).distinct(), key, "left_anti")


def in_scope(rows: DataFrame, scopes: DataFrame, project: str = "project_id") -> DataFrame:
    """(own, the columns of ``rows``): rows of a scope's own project or of one that it lists, from (own, ``project``)."""
    return rows.join(scopes.select("own", project).distinct(), project)


def expand_to_parents(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Distinct ``chunks`` that ``hits`` (chunk_id, parent_id) stand for: the parent where there is one."""
    wanted = hits.select(F.coalesce("parent_id", "chunk_id").alias("chunk_id")).distinct()
    return chunks.join(wanted, "chunk_id", "left_semi")


def suggest_links(pages: DataFrame, queries: DataFrame, n: int = 5) -> DataFrame:
    """(query, slug): the first ``n`` pages (slug, title) by title whose title or slug holds the query, without the page that asks (``self_slug``).

    An asking page takes one slug out, so of each query's hits only those of the first ``n`` + 1 slugs,
    and of a slug the first ``n``, meet the pages that ask: the work is hits and answers, not their product.
    """
    asked = queries.select("query", "self_slug").distinct()
    texts = pages.select("slug", "title", F.col("slug").alias("in_slug"), F.col("title").alias("in_title"))
    hits = substring_hits(texts, ["slug", "title"], ["in_slug", "in_title"], asked, F.col("query")).withColumnRenamed("found", "query")
    hits = latest(hits, ["query", "slug"], [F.col("title")], n)
    hits = hits.withColumn("__first", F.first("title").over(Window.partitionBy("query", "slug").orderBy("title")))
    hits = hits.withColumn("__place", F.dense_rank().over(Window.partitionBy("query").orderBy("__first", "slug"))).where(F.col("__place") <= n + 1)
    hits = hits.drop("nth").join(asked, "query").where(~F.col("slug").eqNullSafe(F.col("self_slug")))
    return latest(hits, ["query", "self_slug"], [F.col("title"), F.col("slug")], n).select("query", "self_slug", "slug")


def work_list(sources: DataFrame, done: DataFrame, keys: Sequence[str] = ("identity", "sha256")) -> DataFrame:
    """``sources`` whose version has not been processed."""
    return sources.join(done.select(*keys), list(keys), "left_anti")


def cache_hit(version: Column, files: Column, wanted: str) -> Column:
    """Whether a cache entry is of the wanted version and names files."""
    return F.coalesce((version == wanted) & (F.size(files) > 0), F.lit(False))


def keys_of_pages(writes: DataFrame, pages: DataFrame) -> DataFrame:
    """(slug, sources, first): how many sources (source, files) wrote each known page (slug), and the first."""
    each = writes.select("source", F.explode("files").alias("slug")).distinct()
    return each.join(pages.select("slug").distinct(), "slug", "left_semi").groupBy("slug").agg(F.count("*").alias("sources"), F.min("source").alias("first"))


def with_assets(meetings: DataFrame, assets: DataFrame, key: str) -> DataFrame:
    """``meetings`` with ``assets``: how many rows of ``assets`` share their key."""
    counts = assets.groupBy(key).agg(F.count("*").alias("assets"))
    return meetings.join(counts, key, "left").withColumn("assets", F.coalesce("assets", F.lit(0)))


def in_order(rows: DataFrame, key: str, order: Sequence[str], value: str) -> DataFrame:
    """(key, values): a key's values in order, as one session's snapshot."""
    sorted_rows = F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("__value"))))
    return rows.groupBy(key).agg(F.transform(sorted_rows, lambda x: x["__value"]).alias("values"))


def search_items(items: DataFrame, word: str, columns: Sequence[str], group: str, order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` of each group's items that hold ``word`` in one of ``columns``, whatever its case."""
    held = F.lit(False)
    for c in columns:
        held = held | F.contains(F.lower(F.col(c)), F.lit(word.lower()))
    return latest(items.where(held), [group], list(order), n).drop("nth")


def normalise_register(rows: DataFrame, ids: Sequence[str], closed: Column) -> DataFrame:
    """``rows`` with ``id`` from the first header that has one, without those closed or without id."""
    first = F.coalesce(*[F.nullif(F.trim(F.col(c)), F.lit("")) for c in ids])
    return rows.withColumn("__id", first).where(F.col("__id").isNotNull() & ~closed).drop(*ids).withColumnRenamed("__id", "id")


def page_of(rows: DataFrame, order: Sequence[Column], offset: int, limit: int) -> DataFrame:
    """One page of a listing: ``limit`` rows after ``offset`` in ``order``."""
    return rows.orderBy(*order).offset(offset).limit(limit)


def identity_of(given: Column, path: Column, default: str = "untitled") -> Column:
    """A source's identity: the given one, else its path's last part, else ``default``."""
    return F.coalesce(F.nullif(F.trim(given), F.lit("")), F.nullif(F.regexp_extract(path, r"([^/\\]+)$", 1), F.lit("")), F.lit(default))


def awaiting(ended: DataFrame, minutes: DataFrame, key: str) -> DataFrame:
    """Ended meetings without minutes."""
    return ended.join(minutes.select(key).distinct(), key, "left_anti")


def review(candidates: DataFrame) -> DataFrame:
    """(slug, version, content, wikilinks) of (slug, version, content, candidate, approve).

    An approved candidate becomes the content and raises the version, a rejected one is cleared;
    links are those of the content, to known pages.
    """
    taken = F.coalesce(F.col("approve"), F.lit(False))
    out = candidates.select("slug", F.when(taken, F.col("candidate")).otherwise(F.col("content")).alias("content"), (F.col("version") + taken.cast("int")).cast("long").alias("version"))
    links = extract_links(out, out, "slug", "content")
    return out.join(links, "slug", "left").withColumn("wikilinks", F.coalesce("wikilinks", F.array().cast("array<string>")))


def merge_meetings(known: DataFrame, fetched: DataFrame, key: str) -> DataFrame:
    """(key, project, status) of known (key, project, status) and fetched (key, project): a known project stays, ignored stays ignored, one with a project is linked."""
    both = known.select(key, F.col("project").alias("p1"), F.col("status").alias("s1")).join(fetched.select(key, F.col("project").alias("p2")), key, "full")
    both = both.withColumn("project", F.coalesce("p1", "p2"))
    return both.select(key, "project", F.when(F.col("s1") == "ignored", "ignored").when(F.col("project").isNotNull(), "linked").otherwise("unlinked").alias("status"))


def payload_rows(payload: Column, paths: Sequence[str], schema: str) -> Column:
    """The array of rows that a JSON payload holds under the first of ``paths`` that it has, or is itself."""
    return F.from_json(F.coalesce(*[F.get_json_object(payload, p) for p in paths], payload), f"array<{schema}>")


def with_counts(projects: DataFrame, tables: dict[str, DataFrame], key: str = "project_id") -> DataFrame:
    """``projects`` with a count of each of ``tables`` (0 without rows), each counted before it is joined."""
    for name, rows in tables.items():
        projects = projects.join(rows.groupBy(key).agg(F.count("*").alias(name)), key, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return projects


def state_counts(rows: DataFrame, key: str, state: str, states: Sequence[str]) -> DataFrame:
    """(key, a column for each of ``states``) with how many rows are in it."""
    return rows.groupBy(key).agg(*[F.count_if(F.col(state) == s).alias(s) for s in states])


def failing_rule(rows: DataFrame, rule: str, severity: str, failed: Column) -> DataFrame:
    """(rule, severity, failed): how many of ``rows`` break a rule; reports are unions of these."""
    return rows.agg(F.count_if(failed).alias("failed")).select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), "failed")


def orphans(rows: DataFrame, parents: DataFrame, key: str, parent_key: str) -> DataFrame:
    return rows.join(parents.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")


def repeated_keys(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).count().where("count > 1")


def match_paths(pages: DataFrame, patterns: DataFrame, path: Column, key: str = "page_id", points: float = 5.0) -> DataFrame:
    """(key, pattern_id, pattern, score): the (pattern_id, pattern) that a page's lower-cased path holds, each worth ``points``."""
    hits = substring_hits(pages.select(key, F.lower(path).alias("path")), [key], ["path"], patterns, F.col("pattern"))
    return hits.join(patterns.withColumnRenamed("pattern", "found"), "found").select(key, "pattern_id", F.col("found").alias("pattern"), F.lit(points).alias("score"))
