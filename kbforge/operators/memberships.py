"""The co-occurrence part of the page graph as memberships: counts, walks and strongest edges without its list of pairs.

Pages of a tag, of a source, or linking the same target are pairwise edges. A group of n pages is
n membership rows (project_id, signal, group, slug) and only implies its n (n - 1) / 2 pairs. All
that is asked of the graph besides the pairs themselves comes from these rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored

GROUP = ["project_id", "signal", "group"]


def memberships(pages: DataFrame, links: DataFrame) -> DataFrame:
    """(project_id, signal, group, slug), distinct, of ``pages`` (tags, sources) and of ``links`` (source_slug, target_slug)."""
    of = lambda column, signal: pages.select("project_id", F.lit(signal).alias("signal"), F.explode(column).alias("group"), "slug")
    cited = links.select("project_id", F.lit("co_citation").alias("signal"), F.col("target_slug").alias("group"), F.col("source_slug").alias("slug"))
    return of("tags", "tag").unionByName(of("sources", "source")).unionByName(cited).distinct()


def signalled(rows: DataFrame, signal: str) -> DataFrame:
    """Distinct (project_id, group, slug) as memberships of one signal."""
    return rows.select("project_id", F.lit(signal).alias("signal"), "group", "slug")


def of_rows(tags: DataFrame, sources: DataFrame, links: DataFrame) -> DataFrame:
    """``memberships`` from distinct rows instead of lists a page: (project_id, group, slug) of tags and of sources, and distinct links."""
    cited = links.select("project_id", F.col("target_slug").alias("group"), F.col("source_slug").alias("slug"))
    return signalled(tags, "tag").unionByName(signalled(sources, "source")).unionByName(signalled(cited, "co_citation"))


def _pairs_of(n: Column) -> Column:
    return (n * (n - 1) / 2).cast("long")


@dataclass(frozen=True)
class Groups:
    """Groups of at least two pages: small ones as ``listed`` (``GROUP``, ids in order), pages of larger ones with the ``sets`` of these (project_id, signal, slug, set)."""

    listed: DataFrame
    sets: DataFrame


def grouped(members: DataFrame, small: int = 64) -> Groups:
    """The groups of ``members``, those of more than ``small`` pages as sets; each is written once for all that is asked of it."""
    key = ["project_id", "signal"]
    large = stored(members.groupBy(*GROUP).agg(F.count("*").alias("n")).where(F.col("n") > small).select(*GROUP), "large")
    if large.isEmpty():
        few, sets = members, members.where(F.lit(False)).groupBy(*key, "slug").agg(F.collect_list("group").alias("set"))
    else:
        few = members.join(large, GROUP, "left_anti")
        sets = members.join(large, GROUP).groupBy(*key, "slug").agg(F.sort_array(F.collect_list("group")).alias("set"))
    listed = few.groupBy(*GROUP).agg(F.sort_array(F.collect_list("slug")).alias("ids")).where(F.size("ids") > 1)
    return Groups(stored(listed, "listed"), stored(sets, "sets"))


def pair_counts(members: DataFrame, small: int = 64, subsets: int = 10, groups: Groups | None = None) -> DataFrame:
    """(project_id, signal, pairs): how many pairs of pages share a group, each counted once.

    Groups of up to ``small`` pages are paired, which is at most ``small`` / 2 rows a membership. Pages
    of larger groups fold into classes with equal sets of these; with n(S) pages in all groups of S,
    the pairs that share any are the alternating sum of the pairs of n(S) over the subsets S of a
    class's set. Classes in more than ``subsets`` large groups, whose subsets would be too many, are
    paired with the classes that they meet, as classes. Pairs that small groups give and large ones
    have too are taken off.
    """
    key = ["project_id", "signal"]
    groups = groups or grouped(members, small)
    listed, sets = groups.listed, groups.sets
    each_page = F.expr("transform(slice(ids, 1, size(ids) - 1), (a, i) -> struct(a as a, slice(ids, i + 2, size(ids)) as later))")
    partners = listed.select(*key, F.inline(each_page)).groupBy(*key, "a").agg(F.array_distinct(F.flatten(F.collect_list("later"))).alias("later"))
    classes = sets.groupBy(*key, "set").agg(F.count("*").alias("n"))
    light, heavy = classes.where(F.size("set") <= subsets), classes.where(F.size("set") > subsets)
    parts = light.select(*key, "n", "set", F.explode(F.expr("sequence(1L, shiftleft(1L, size(set)) - 1)")).alias("mask"))
    parts = parts.select(*key, "n", F.expr("filter(set, (x, i) -> shiftright(mask, i) % 2 = 1)").alias("part"))
    met = parts.groupBy(*key, "part").agg(F.sum("n").alias("n"))
    of_light = met.select(*key, (F.when(F.size("part") % 2 == 1, 1).otherwise(-1) * _pairs_of(F.col("n"))).alias("pairs"))

    each = classes.select(*key, F.col("set").alias("b"), "n", F.explode("set").alias("group"), (F.size("set") > subsets).alias("heavy"))
    other = each.where("heavy").select(*GROUP, F.col("b").alias("a"), F.col("n").alias("m"))
    crossed = each.join(other, GROUP).where("a < b or not heavy").select(*key, "a", "b", (F.col("n") * F.col("m")).alias("pairs")).distinct().select(*key, "pairs")
    of_heavy = crossed.unionByName(heavy.select(*key, _pairs_of(F.col("n")).alias("pairs")))

    x, y = (sets.select(*key, F.col("slug").alias(c), F.col("set").alias(f"of_{c}")) for c in "ab")
    both = listed.join(F.broadcast(stored(sets.select(*key).distinct(), "scopes")), key, "left_semi")  # a scope without large groups has nothing to take off
    later = F.expr("flatten(transform(ids, (a, i) -> transform(slice(ids, i + 2, size(ids)), b -> struct(a as a, b as b))))")
    both = both.select(*key, F.inline(later)).distinct()
    twice = both.join(x, [*key, "a"]).join(y, [*key, "b"]).where(F.arrays_overlap("of_a", "of_b"))
    ones = partners.groupBy(*key).agg(F.sum(F.size("later")).alias("pairs"))
    found = ones.unionByName(twice.groupBy(*key).agg((-F.count("*")).alias("pairs"))).unionByName(of_light).unionByName(of_heavy)
    return found.groupBy(*key).agg(F.sum("pairs").cast("long").alias("pairs")).where("pairs > 0")


def paired_pages(members: DataFrame, groups: Groups | None = None) -> DataFrame:
    """(project_id, slug): the pages that share some group with another."""
    groups = groups or grouped(members)
    return groups.listed.select("project_id", F.explode("ids").alias("slug")).unionByName(groups.sets.select("project_id", "slug")).distinct()


def first_pairs(members: DataFrame, k: int) -> DataFrame:
    """(project_id, signal, source_slug, target_slug): the first ``k`` pairs of each project and signal, by both slugs.

    The pages before one in a group all have a later partner there. So the first ``k`` pages with a
    partner are among the first ``k`` of their groups, and their first ``k`` partners among the first
    2k: no more of a group is read. Partners are joined only for as many pages as give ``k`` pairs.
    """
    key = ["project_id", "signal"]
    nth = F.row_number().over(Window.partitionBy(*GROUP).orderBy("slug"))
    rows = stored(members.withColumn("nth", nth).where(F.col("nth") <= 2 * k), "first")  # the cut is pushed below the shuffle
    size = rows.groupBy(*GROUP).agg(F.max("nth").alias("n"))
    behind = rows.join(size, GROUP).where("nth < n").groupBy(*key, "slug").agg(F.least(F.max(F.col("n") - F.col("nth")), F.lit(k)).alias("least"))
    by_slug = Window.partitionBy(*key).orderBy("slug")
    pages = behind.withColumn("place", F.row_number().over(by_slug)).where(F.col("place") <= k)
    pages = pages.withColumn("before", F.coalesce(F.sum("least").over(by_slug.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where(F.col("before") < k)
    asked = rows.join(pages.select(*key, "slug"), [*key, "slug"]).select(*GROUP, F.col("slug").alias("source_slug"), F.col("nth").alias("at"))
    met = asked.join(rows.withColumnRenamed("slug", "target_slug"), GROUP).where((F.col("nth") > F.col("at")) & (F.col("nth") <= F.col("at") + k))
    pairs = met.select(*key, "source_slug", "target_slug").distinct()
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("source_slug", "target_slug"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")


def by_hash(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """An inner join on ``on`` that sorts by a hash of these first: a few projects and texts of equal beginnings tell rows apart slowly."""
    left, right = (x.withColumn("__hash", F.xxhash64(*on)) for x in (left, right))
    return left.join(right, ["__hash", *on]).drop("__hash")


def passages(members: DataFrame) -> DataFrame:
    """The ``members`` without those that are alone in their group and lead nowhere.

    Groups are told apart by 64 bits here, which may keep a few more; nothing that leads on is lost.
    """
    members = members.withColumn("__group", F.xxhash64(*GROUP))
    several = members.groupBy("__group").agg(F.count("*").alias("n")).where("n > 1").select("__group")
    return members.join(several, "__group").drop("__group")


def step(frontier: DataFrame, members: DataFrame) -> DataFrame:
    """(project_id, seed, to, signal) that pairs lead to from (project_id, seed, at): page to group to later page, repeated if several groups do.

    A group that a seed reaches by several pages is entered once, at the first of them.
    """
    entered = by_hash(frontier, members.withColumnRenamed("slug", "at"), ["project_id", "at"]).groupBy(*GROUP, "seed").agg(F.min("at").alias("at"))
    return by_hash(entered, members.withColumnRenamed("slug", "to"), GROUP).where("to > at").select("project_id", "seed", "to", "signal")
