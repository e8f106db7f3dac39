"""The page graph: four edge signals, statistics, bounded traversal, recommendations.

Pages of a group are pairwise edges; ``memberships`` answers what is asked of them without a row a
pair, which only ``tag_edges``, ``source_edges``, ``co_citation_edges`` and ``build_graph`` list.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import memberships
from .pairs import pairs_once

#: Edge weights by signal.
WEIGHTS = {"wikilink": 1.0, "tag": 0.6, "source": 0.4, "co_citation": 0.3}
weight_of = lambda signal: F.element_at(F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv]), F.col(signal))
EDGE = ["project_id", "source_slug", "target_slug", "signal", "weight"]


def wikilink_edges(pages: DataFrame) -> DataFrame:
    """Directed edges of pages to the slugs that they link, without blanks and self-links."""
    links = pages.select("project_id", F.col("slug").alias("source_slug"), F.explode("wikilinks").alias("target_slug"))
    return as_wikilinks(links.where((F.trim("target_slug") != "") & (F.col("source_slug") != F.col("target_slug"))).distinct())


def as_wikilinks(links: DataFrame) -> DataFrame:
    """Distinct (project_id, source_slug, target_slug) as edges."""
    return links.withColumns({"signal": F.lit("wikilink"), "weight": F.lit(WEIGHTS["wikilink"])})


def co_occurrence_edges(members: DataFrame, signal: str, per_group: int | None = None) -> DataFrame:
    """Pairs a < b of slugs that share a group of (project_id, group, slug): all of them, or those of its first ``per_group`` slugs.

    The pairs are the result and grow as groups squared, which ``per_group`` bounds where that is
    wanted; large groups are dealt over tasks (``pairs_once``).
    """
    if per_group is not None:
        members = members.select("project_id", "group", "slug").distinct()
        nth = F.row_number().over(Window.partitionBy("project_id", "group").orderBy("slug"))
        members = members.withColumn("nth", nth).where(F.col("nth") <= per_group).drop("nth")
    pairs = pairs_once(members, ["project_id"], "group", "slug", task_pairs=1 << 22).select("project_id", F.col("x").alias("source_slug"), F.col("y").alias("target_slug"))
    return pairs.withColumns({"signal": F.lit(signal), "weight": F.lit(WEIGHTS[signal])})


def tag_edges(pages: DataFrame, per_group: int | None = None) -> DataFrame:
    return co_occurrence_edges(pages.select("project_id", F.explode("tags").alias("group"), "slug"), "tag", per_group)


def source_edges(pages: DataFrame, per_group: int | None = None) -> DataFrame:
    return co_occurrence_edges(pages.select("project_id", F.explode("sources").alias("group"), "slug"), "source", per_group)


def co_citation_edges(links: DataFrame) -> DataFrame:
    """Pairs of pages that link to the same target."""
    return co_occurrence_edges(links.select("project_id", F.col("target_slug").alias("group"), F.col("source_slug").alias("slug")), "co_citation")


def build_graph(pages: DataFrame, per_group: int | None = None) -> DataFrame:
    """Edges of all four signals; ``per_group`` bounds how many pages of a tag or source are paired."""
    links = wikilink_edges(pages)
    return links.select(EDGE).unionByName(tag_edges(pages, per_group)).unionByName(source_edges(pages, per_group)).unionByName(co_citation_edges(links))


def extract_links(rows: DataFrame, known: DataFrame, slug: str, text: str) -> DataFrame:
    """(slug, wikilinks): sorted distinct ``[[slug]]`` or ``[[slug|label]]`` targets that exist in ``known`` (slug), without self."""
    found = rows.select(F.col(slug).alias("from"), F.explode(F.regexp_extract_all(text, F.lit(r"\[\[([^\]|]+)(?:\|[^\]]*)?\]\]"), F.lit(1))).alias("slug"))
    found = found.withColumn("slug", F.trim("slug")).where("slug <> '' and slug <> from").distinct()
    return found.join(known.select("slug"), "slug", "left_semi").groupBy("from").agg(F.array_sort(F.collect_set("slug")).alias("wikilinks")).withColumnRenamed("from", "slug")


def backfill_links(pages: DataFrame) -> DataFrame:
    """``pages`` (slug, wikilinks, candidate, content): pages without links get those in the candidate, else the content."""
    text = F.coalesce(F.when(F.trim("candidate") != "", F.col("candidate")), F.col("content"))
    empty = pages.where(F.size("wikilinks") == 0).withColumn("__text", text)
    found = extract_links(empty, pages, "slug", "__text").withColumnRenamed("wikilinks", "__found")
    out = pages.join(found, "slug", "left")
    return out.withColumn("wikilinks", F.when(F.size("wikilinks") == 0, F.coalesce("__found", "wikilinks")).otherwise(F.col("wikilinks"))).drop("__found")


def traverse(edges: DataFrame, seeds: DataFrame, depth: int = 2, least: float = 0.3, cut: Callable[[DataFrame], DataFrame] = lambda f: f, members: DataFrame | None = None) -> DataFrame:
    """Bounded walks from many (project_id, seed): per target its depths, signals (those of ``WEIGHTS``) and mean weight.

    Each hop joins the frontier with the edges and is made distinct, so the work is bounded by
    distinct (seed, target, signal, weight) rows. ``members`` are ``memberships`` whose pairs are
    edges too, walked from page to group to page. ``cut`` may write out what is read for several
    hops: a frontier, and the memberships that lead anywhere. Walks are dealt by seed and target
    once, and made distinct and summed up where they lie.
    """
    strong = edges.where(F.col("weight") >= least).select("project_id", F.col("source_slug").alias("at"), F.col("target_slug").alias("to"), "signal", "weight")
    if members is not None:
        members = cut(memberships.passages(members.where(weight_of("signal") >= least)))
    frontier = seeds.select("project_id", "seed", F.col("seed").alias("at"))
    walked = None
    for hop in range(1, depth + 1):
        ends = frontier.select("project_id", "seed", "at").distinct()
        step = memberships.by_hash(ends, strong, ["project_id", "at"]).select("project_id", "seed", "to", "signal", "weight")
        if members is not None:
            step = step.unionByName(memberships.step(ends, members).withColumn("weight", weight_of("signal")))
        step = step.where("to <> seed").select("project_id", "seed", F.col("to").alias("at"), "signal", "weight")
        if hop < depth:
            step = frontier = cut(step.distinct())
        step = step.withColumn("depth", F.lit(hop))
        walked = step if walked is None else walked.unionByName(step)
    each = walked.repartition("project_id", "seed", "at").distinct()
    names = sorted(WEIGHTS)
    bits = F.create_map(*[F.lit(x) for k, name in enumerate(names) for x in (name, 1 << k)])
    unknown = F.raise_error(F.concat(F.lit("no such signal: "), "signal")).cast("int")
    bit = F.coalesce(F.element_at(bits, F.col("signal")), F.when(F.col("signal").isNotNull(), unknown))
    found = each.groupBy("project_id", "seed", F.col("at").alias("target")).agg(
        F.max("depth").cast("long").alias("depth"), F.min("depth").cast("long").alias("min_depth"), F.bit_or(bit).alias("bits"), F.round(F.avg("weight"), 6).alias("weight")
    )
    signals = F.array_compact(F.array(*[F.when(F.col("bits").bitwiseAND(1 << k) != 0, F.lit(name)) for k, name in enumerate(names)]))
    return found.select("project_id", "seed", "target", "depth", "min_depth", signals.alias("signals"), "weight")


def recommend(walks: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` best targets of each seed: mean weight over the number of signals, with a bonus of a tenth for each further one, at most 1."""
    n = F.size("signals")
    score = F.round(F.least(F.col("weight") / n * (1 + 0.1 * (n - 1)), F.lit(1.0)), 6)
    rows = walks.withColumn("score", score)
    nth = F.row_number().over(Window.partitionBy("project_id", "seed").orderBy(F.col("score").desc(), "depth", "target"))
    return rows.withColumn("rank", nth.cast("long")).where(F.col("rank") <= k)


def signal_counts(links: DataFrame, members: DataFrame, groups: memberships.Groups | None = None) -> DataFrame:
    """(project_id, signal, n, weight): how many edges each signal has, and their weights' sum, from ``wikilink_edges`` and ``memberships``."""
    direct = links.groupBy("project_id", "signal").agg(F.count("*").alias("n"))
    counts = direct.unionByName(memberships.pair_counts(members, groups=groups).withColumnRenamed("pairs", "n"))
    return counts.withColumn("weight", F.round(F.col("n") * weight_of("signal"), 4))


def statistics(links: DataFrame, members: DataFrame) -> DataFrame:
    """Per project: edges, nodes, edges of each signal, edges a node, of the graph of ``wikilink_edges`` and ``memberships``."""
    groups = memberships.grouped(members)
    ends = links.select("project_id", F.explode(F.array("source_slug", "target_slug")).alias("slug"))
    nodes = ends.unionByName(memberships.paired_pages(members, groups)).distinct().groupBy("project_id").agg(F.count("*").alias("nodes"))
    of = lambda s: F.coalesce(F.sum(F.when(F.col("signal") == s, F.col("n"))), F.lit(0)).alias(f"n_{s}")
    counts = signal_counts(links, members, groups).groupBy("project_id").agg(F.sum("n").alias("edges"), *map(of, WEIGHTS))
    return counts.join(nodes, "project_id").withColumn("density", F.round(F.col("edges") / F.col("nodes"), 6))


def strongest(links: DataFrame, members: DataFrame, most: int) -> DataFrame:
    """``EDGE`` rows among which are the strongest ``most`` edges of each project, by weight and slugs."""
    nth = F.row_number().over(Window.partitionBy("project_id").orderBy("source_slug", "target_slug"))
    direct = links.withColumn("nth", nth).where(F.col("nth") <= most)
    return direct.select(EDGE).unionByName(memberships.first_pairs(members, most).withColumn("weight", weight_of("signal")).select(EDGE))


def degrees(edges: DataFrame) -> DataFrame:
    """(project_id, slug, degree) over both ends."""
    return edges.select("project_id", F.explode(F.array("source_slug", "target_slug")).alias("slug")).groupBy("project_id", "slug").agg(F.count("*").alias("degree"))


def display_graph(edges: DataFrame, pages: DataFrame, most: int = 5000) -> DataFrame:
    """Nodes of the strongest ``most`` edges of each project, with degree, title and type (``unknown`` without a page)."""
    order = [F.col("weight").desc(), F.col("source_slug"), F.col("target_slug"), F.col("signal")]
    shown = edges.withColumn("nth", F.row_number().over(Window.partitionBy("project_id").orderBy(*order))).where(F.col("nth") <= most)
    info = pages.select("project_id", "slug", "title", "page_type")
    found = degrees(shown).join(info, ["project_id", "slug"], "left")
    return found.select("project_id", "slug", "degree", F.coalesce("title", "slug").alias("title"), F.coalesce("page_type", F.lit("unknown")).alias("page_type"))


def neighbours(edges: DataFrame, pages: DataFrame) -> DataFrame:
    info = pages.select("project_id", F.col("slug").alias("target_slug"), "title")
    return edges.join(info, ["project_id", "target_slug"], "left")


def diagnose(pages: DataFrame, bracketed: Column) -> DataFrame:
    """Per project: pages, pages with links, three samples of them, pages whose text holds brackets."""
    linked = F.size("wikilinks") > 0
    counts = pages.groupBy("project_id").agg(F.count("*").alias("pages"), F.count_if(linked).alias("linked"), F.count_if(bracketed).alias("bracketed"))
    nth = F.row_number().over(Window.partitionBy("project_id").orderBy("slug"))  # the cut is pushed below the shuffle
    first = pages.where(linked & F.col("slug").isNotNull()).select("project_id", "slug").withColumn("nth", nth).where("nth <= 3")
    shown = first.groupBy(F.col("project_id").alias("__of")).agg(F.array_sort(F.collect_list("slug")).alias("samples"))
    found = counts.join(shown, F.col("project_id").eqNullSafe(F.col("__of")), "left")
    return found.select("project_id", "pages", "linked", F.coalesce("samples", F.array().cast("array<string>")).alias("samples"), "bracketed")
