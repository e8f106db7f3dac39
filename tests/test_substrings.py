"""Substring joins against comparing every text with every string."""

import random

import pytest
from pyspark.sql import functions as F

from kbforge.operators import lookups, retrieval, substrings
from kbforge.plans import registry

SF = "/root/testdata/sf0.001"


def pairs(hits):
    return sorted((r.k, r.found, r.a, r.b) for r in hits.collect())


def test_equals_every_comparison(spark):
    random.seed(3)
    text = lambda n: "".join(random.choices("abcé😀 ", k=n))
    texts = [(k, text(random.randint(0, 30)), random.choice([None, text(10)])) for k in range(120)] + [(200, None, None), (201, "", ""), (7, "abc", "abc")]
    strings = [text(random.randint(1, 4)) for _ in range(150)] + ["", None, "a", "ab", "abc", "bc", "x" * 50]
    want = sorted((k, s, a is not None and s in a, b is not None and s in b) for k, a, b in texts for s in {s for s in strings if s is not None} if s in (a or "") and a is not None or b is not None and s in b)
    df, asked = spark.createDataFrame(texts, "k long, a string, b string"), spark.createDataFrame([(s,) for s in strings], "s string")
    assert pairs(substrings.substring_hits(df, ["k"], ["a", "b"], asked, F.col("s"))) == want
    assert pairs(substrings.substring_hits(df, ["k"], ["a", "b"], asked, F.col("s"), turn_bytes=2000)) == want  # several turns


def test_none_asked_and_no_texts(spark):
    df = spark.createDataFrame([(1, "abc", "x")], "k long, a string, b string")
    none = spark.createDataFrame([], "s string")
    assert pairs(substrings.substring_hits(df, ["k"], ["a", "b"], none, F.col("s"))) == []
    assert pairs(substrings.substring_hits(df, ["k"], ["a", "b"], spark.createDataFrame([("",)], "s string"), F.col("s"))) == [(1, "", True, True)]
    assert pairs(substrings.substring_hits(df.limit(0), ["k"], ["a", "b"], spark.createDataFrame([("a",)], "s string"), F.col("s"))) == []


def test_hits_are_handed_on(spark, monkeypatch):
    monkeypatch.setattr(substrings, "HELD", 3)
    df = spark.createDataFrame([(k, "abcdef", None) for k in range(5)], "k long, a string, b string").coalesce(1)
    asked = spark.createDataFrame([(c,) for c in "abcdefg"], "s string")
    assert pairs(substrings.substring_hits(df, ["k"], ["a", "b"], asked, F.col("s"))) == [(k, c, True, False) for k in range(5) for c in "abcdef"]


def test_many_phrases_in_one_pass(spark):
    """Fifty thousand phrases, each a term of the chunks that hold it."""
    lines = spark.range(2000).select(F.lit("p").alias("project_id"), F.col("id").alias("chunk_id"), F.concat(F.lit("before k"), "id", F.lit("x m"), F.col("id") * 25, F.lit("y after")).alias("content"))
    phrases = spark.range(50000).select(F.concat(F.lit("M"), "id", F.lit("Y AFTER")).alias("phrase"))
    lists = retrieval.posting_lists(lines, F.split("content", " "))
    found = retrieval.postings(retrieval.with_phrases(lines, lists, phrases, F.col("content"))).where(F.contains("term", F.lit(" ")))
    assert sorted((r.chunk_id, r.term, r.tf) for r in found.collect()) == [(k, f"m{25 * k}y after", 1) for k in range(2000)]


@pytest.mark.parametrize("name", ["r4_phrase_postings", "r12_shortcut", "j7_own_suggestions", "j7_link_suggestions", "j14_cells", "r19_path_match", "r22_end_to_end"])
def test_no_nested_loops(spark, name):
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_pages_of_one_title_ask_without_meeting_all_of_them(spark):
    """Equal titles, a slug of several titles, null titles; the hits of a query are cut before they meet its askers."""
    pages = [(f"p{k:03d}", "same title") for k in range(200)] + [("p000", "a same title"), ("p001", None), ("p001", "same title"), ("same title", None), ("p002", "same titles")]
    asked = [("same title", f"p{k:03d}") for k in range(200)] + [("same title", None), ("p00", "p001"), ("none", "p001")]
    made = lookups.suggest_links(spark.createDataFrame(pages, "slug string, title string"), spark.createDataFrame(asked, "query string, self_slug string"), 3)
    want = []
    for query, own in set(asked):
        hits = sorted(((t is not None, t or "", s) for s, t in pages if (query in (t or "") or query in s) and s != own))
        want += [(query, own, s) for _, _, s in hits[:3]]
    key = lambda r: tuple(x or "" for x in r)
    assert sorted(map(tuple, made.collect()), key=key) == sorted(want, key=key)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "dense_rank" in plan[plan.index("Join") :]
