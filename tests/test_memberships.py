"""The graph from memberships against the graph that lists every pair."""

import random

import pytest
from pyspark.sql import functions as F

from kbforge.operators import graph, memberships


@pytest.fixture(scope="module")
def world(spark):
    random.seed(7)
    slugs = [f"s{k:02d}" for k in range(40)]
    rows = [
        (k % 2, s, random.sample("ABCDEFGH", random.randint(0, 6)) + (["all"] if k % 3 else []), random.sample(slugs, random.randint(0, 3)), random.sample(["u", "v", "w", f"own{k}"], random.randint(0, 2)))
        for k, s in enumerate(slugs)
    ]
    pages = spark.createDataFrame(rows, "project_id long, slug string, tags array<string>, wikilinks array<string>, sources array<string>")
    links = graph.wikilink_edges(pages).select(graph.EDGE)
    return pages, links, memberships.memberships(pages, links).cache()


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.mark.parametrize("small,subsets", [(64, 10), (3, 10), (3, 2), (1, 0), (1, 10)])
def test_pairs_are_counted_once(world, small, subsets):
    pages, links, members = world
    want = graph.build_graph(pages).where("signal <> 'wikilink'").groupBy("project_id", "signal").agg(F.count("*").alias("pairs"))
    assert rows_of(memberships.pair_counts(members, small, subsets), "project_id", "signal", "pairs") == rows_of(want, "project_id", "signal", "pairs")


def test_statistics_of_the_whole_graph(world):
    pages, links, members = world
    edges = graph.build_graph(pages)
    ends = edges.select("project_id", F.explode(F.array("source_slug", "target_slug")).alias("slug")).distinct().groupBy("project_id").agg(F.count("*").alias("nodes"))
    want = edges.groupBy("project_id").agg(F.count("*").alias("edges"), F.count_if(F.col("signal") == "tag").alias("n_tag"), F.count_if(F.col("signal") == "wikilink").alias("n_wikilink")).join(ends, "project_id")
    columns = ["project_id", "edges", "n_tag", "n_wikilink", "nodes"]
    assert rows_of(graph.statistics(links, members), *columns) == rows_of(want, *columns)


@pytest.mark.parametrize("most", [1, 4, 17, 1000])
def test_strongest_edges(world, most):
    pages, links, members = world
    shown = lambda edges: rows_of(graph.display_graph(edges, pages.withColumns({"title": F.col("slug"), "page_type": F.lit("p")}), most), "project_id", "slug", "degree")
    assert shown(graph.strongest(links, members, most)) == shown(graph.build_graph(pages))
    firsts = memberships.first_pairs(members, most).groupBy("project_id", "signal").count()
    assert all(r["count"] <= most for r in firsts.collect())


@pytest.mark.parametrize("least", [0.3, 0.5])
def test_walks(spark, world, least):
    pages, links, members = world
    seeds = pages.where("slug < 's12'").select("project_id", F.col("slug").alias("seed"))
    columns = ["project_id", "seed", "target", "depth", "min_depth", "signals", "weight"]
    assert rows_of(graph.traverse(links, seeds, 3, least, members=members), *columns) == rows_of(graph.traverse(graph.build_graph(pages), seeds, 3, least), *columns)


def test_empty(spark, world):
    none = world[2].limit(0)
    assert memberships.pair_counts(none).collect() == [] and memberships.first_pairs(none, 5).collect() == [] and memberships.paired_pages(none).collect() == []


def test_groups_are_written_once_for_counts_and_pages(spark):
    """Pairs of small groups are counted by page without a row a pair; groups of one page are in neither part."""
    rows = [(1, "tag", "big", f"p{k}") for k in range(6)] + [(1, "source", "s", f"p{k}") for k in range(3)] + [(1, "source", "t", f"p{k}") for k in range(1, 4)] + [(1, "tag", "two", "p0"), (1, "tag", "two", "p1"), (1, "source", "one", "q"), (None, "source", "s", "a")]
    members = spark.createDataFrame(rows, "project_id long, signal string, group string, slug string")
    groups = memberships.grouped(members, small=3)
    assert sorted(tuple(r) for r in groups.listed.selectExpr("signal", "group", "size(ids)").collect()) == [("source", "s", 3), ("source", "t", 3), ("tag", "two", 2)]
    assert groups.sets.count() == 6
    assert sorted(tuple(r) for r in memberships.pair_counts(members, groups=groups).collect()) == [(1, "source", 5), (1, "tag", 15)]
    assert sorted(r.slug for r in memberships.paired_pages(members, groups).collect()) == [f"p{k}" for k in range(6)]


def test_titles_read_parts_only(spark):
    """Titles of pages are those of the whole pages, without reading what pages link."""
    from kbforge.plans import fixtures

    sf = "/root/testdata/sf0.001"
    titles = fixtures.page_titles(spark, sf)
    assert [f.rsplit("/", 1)[1] for f in titles.inputFiles()] == ["part.parquet"]
    assert sorted(titles.collect()) == sorted(fixtures.wiki_pages(spark, sf).select(titles.columns).collect())


def test_walks_take_rows_not_lists(spark):
    """Links, sources and tags come as distinct rows, equal to the lists of the whole pages; no list of a page is built for a walk."""
    from kbforge.plans import fixtures, graph_queries

    sf = "/root/testdata/sf0.001"
    pages = fixtures.wiki_pages(spark, sf)
    links = graph.wikilink_edges(pages).select("project_id", "source_slug", "target_slug")
    made = fixtures.page_links(spark, sf)
    assert rows_of(made, *links.columns) == rows_of(links, *links.columns)
    columns = ["project_id", "signal", "group", "slug"]
    rows = memberships.of_rows(fixtures.page_tags(spark, sf), fixtures.page_sources(spark, sf), made)
    assert rows_of(rows, *columns) == rows_of(memberships.memberships(pages, links), *columns)
    walk = graph_queries.QUERIES["g7_traverse"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_" not in walk


def test_members_alone_in_their_group_are_not_walked(spark):
    rows = [(1, "source", "s", "a"), (1, "source", "s", "b"), (1, "source", "own", "a"), (2, "source", "s", "c"), (None, "source", "s", "d")]
    members = spark.createDataFrame(rows, "project_id long, signal string, group string, slug string")
    assert rows_of(memberships.passages(members), "group", "slug") == [("s", "a"), ("s", "b")]
    odd = spark.createDataFrame([(1, "a", "b", "other", 1.0)], "project_id long, source_slug string, target_slug string, signal string, weight double")
    with pytest.raises(Exception, match="no such signal: other"):
        graph.traverse(odd, spark.createDataFrame([(1, "a")], "project_id long, seed string")).collect()
