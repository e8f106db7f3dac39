"""Golden cases and invariants of single operators."""

import datetime
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kbforge.functions import text as t
from kbforge.functions import transcript
from kbforge.operators import analytics, chunking, graph, index, logs, maintenance, pairs, redaction, retrieval, verification
from kbforge.sources import files
from kbforge.streaming import streams


def one(spark, make, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(make(F.col("x"))).first()[0]


def test_clean_markup(spark):
    clean = lambda x: one(spark, t.clean_markup, x)
    assert clean("see [label](http://a) ![pic](b.png) now") == "see label now"
    assert clean("<p>a</p>\n\n\n\nb  c \n") == "a\n\nb c"
    assert clean("x\n```\n<b>  [k](v)\n```\n<i>y</i>") == "x\n```\n<b>  [k](v)\n```\ny"
    assert clean("a ```<b>open") == "a ```open"
    assert clean("") == "" and clean(None) is None


def test_titles_slugs_languages(spark):
    title = lambda x: spark.createDataFrame([(x,)], "x string").select(t.title_of(F.col("x"), F.lit("fallback"))).first()[0]
    assert title("intro\n# Head\nx") == "Head" and title("\n  first\nsecond") == "first" and title("x" * 121) == "fallback" and title("") == "fallback"
    assert one(spark, t.slugify, "Hello, World! 你好") == "hello-world-你好"
    assert [one(spark, t.language_class, x) for x in ("", "abc", "中文字", "abcdefghij中")] == ["unknown", "en", "zh", "zh-en"]
    assert one(spark, t.word_count, "中文 and 12 words") == 4
    assert one(spark, t.ngram_tokens, "用友ERP系统") == ["用友", "系统", "erp"]
    assert one(spark, t.entities, "《手册》由金蝶公司在 ERP 中") == ["手册", "由金蝶公司", "ERP"]


def test_sentences_and_budgets(spark):
    assert one(spark, t.sentences, "你好世界。再见了！v1.5 is out. Next? yes") == ["你好世界。", "再见了！", "v1.5 is out.", "Next?"]
    assert one(spark, t.keep_separators, "甲。乙；丙") == ["甲。", "乙；", "丙"]
    assert one(spark, t.token_estimate, "abcdefg") == 2 and one(spark, t.token_estimate, "中") == 2
    for text in ("a" * 5000, "中文" * 800, "", "short"):
        cut = one(spark, lambda x: t.truncate_to_budget(x, 100), text)
        assert text.startswith(cut) and one(spark, t.token_estimate, cut) <= 100
        assert cut == text or one(spark, t.token_estimate, text[: len(cut) + 1]) > 100
    assert one(spark, t.first_injection_phrase, "Now IGNORE previous instructions") == "ignore previous instructions"
    assert one(spark, t.scrub_context, "a<context>b</context>c<context>d") == "ac"
    assert one(spark, t.citations, "[来源：a.md] （来源：b.md） [src:3] [chunk:9]") == ["a.md", "b.md", "3", "9"]
    assert one(spark, t.json_of_answer, 'x {"a": {"b": 1}} y') == '{"a": {"b": 1}}'


def test_change_ratio(spark):
    ratio = lambda a, b, cut=5000: spark.createDataFrame([(a, b)], "a string, b string").select(t.change_ratio(F.col("a"), F.col("b"), cut)).first()[0]
    assert ratio("abcd", "abcx") == 0.25 and ratio("", "") == 0.0 and ratio("abcd", "xabc", 3) == 1.0


def test_chunks_cover_and_stay_in_size(spark):
    text = "\n".join(f"Paragraph {k} has some words. It goes on for a while, then stops." * (1 + k % 4) for k in range(60)) + "\n" + "x" * 5000
    packed = chunking.pack_paragraphs(text)
    assert "Paragraph 0" in packed[0] and all(f"Paragraph {k} " in "\n".join(packed) for k in range(60))
    assert all(chunking.size_of(c) <= chunking.TARGET * 1.16 + 1 or "x" * 800 in c for c in packed)
    levelled = chunking.level_sizes(packed)
    assert all(chunking.size_of(c) <= chunking.LARGE or " " not in c for c in levelled)
    assert chunking.pack_paragraphs("") == [] and chunking.pack_paragraphs("short text") == ["short text"]
    assert all(chunking.CHILD_MIN <= len(c) for c in chunking.children_of(levelled[0])) and chunking.children_of("tiny") == []
    rows = spark.createDataFrame([(1, k, f"line {k}", 40 + k % 30) for k in range(120)], "document_id long, line_no long, content string, tokens long")
    out = chunking.budget_batches(rows, 220)
    assert out.count() == 120 and out.groupBy("batch_no").agg(F.sum("tokens").alias("s")).where("s > 220").isEmpty()


def test_links_and_backfill(spark):
    pages = spark.createDataFrame([("a", ["b", "c"], "", ""), ("b", ["a"], "", ""), ("c", [], " ", "see [[a]] [[b|B]] [[a]] [[c]] [[zzz]] [x]")], "slug string, wikilinks array<string>, candidate string, content string")
    out = {r.slug: r.wikilinks for r in graph.backfill_links(pages).collect()}
    assert out == {"a": ["b", "c"], "b": ["a"], "c": ["a", "b"]}
    edges = graph.wikilink_edges(spark.createDataFrame([(1, s, w) for s, w in out.items()], "project_id long, slug string, wikilinks array<string>"))
    assert edges.count() == 5
    walks = graph.traverse(edges, spark.createDataFrame([(1, "a")], "project_id long, seed string"))
    assert {(r.target, r.depth, r.min_depth) for r in walks.collect()} == {("b", 2, 1), ("c", 1, 1)}


def test_diagnose_takes_three_samples_without_gathering(spark, capsys):
    rows = [(1, f"s{9 - k}", ["x"], "[[x]]") for k in range(6)] + [(1, "a", [], ""), (2, "b", [], "[["), (None, "c", ["x"], "")]
    out = graph.diagnose(spark.createDataFrame(rows, "project_id long, slug string, wikilinks array<string>, content string"), F.contains("content", F.lit("[[")))
    found = {r.project_id: (r.pages, r.linked, r.samples, r.bracketed) for r in out.collect()}
    assert found == {1: (7, 6, ["s4", "s5", "s6"], 6), 2: (1, 0, [], 1), None: (1, 1, ["c"], 0)}
    out.explain()
    assert "WindowGroupLimit" in capsys.readouterr().out


def test_bm25_ranks_scopes_and_deletes(spark):
    rows = spark.createDataFrame([(1, "a", "alpha beta gamma"), (2, "a", "delta epsilon zeta"), (3, "b", "delta delta eta")], "chunk_id long, project_id string, content string")
    posted = retrieval.posting_lists(rows, F.split("content", " "))
    asked = spark.createDataFrame([(1, "delta"), (1, "epsilon")], "query_id long, term string")
    assert retrieval.bm25(asked, posted).orderBy("rank").first().chunk_id == 2
    assert [r.chunk_id for r in retrieval.bm25(asked, posted.where("project_id = 'b'")).collect()] == [3]
    assert retrieval.bm25(asked, posted.where("project_id = 'c'")).isEmpty()
    assert [r.chunk_id for r in retrieval.bm25(asked, posted.where("chunk_id <> 2")).collect()] == [3]


def test_vectors_find_themselves_and_zero_norm(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 0.0]), (4, [1.0])], "vec_id long, embedding array<double>")
    q = spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, vector array<double>")
    out = [(r.vec_id, r.similarity) for r in retrieval.nearest(q, v, 4).orderBy("rank").collect()]
    assert out[0] == (1, 1.0) and out[1][0] == 2 and out[2:] == [(3, 0.0), (4, 0.0)]


def test_any_number_of_queries_is_answered(spark):
    ids = spark.range(60)
    v = ids.select(F.col("id").alias("vec_id"), F.array(F.cos("id"), F.sin("id"), (F.col("id") % 3).cast("double")).alias("embedding"))
    q = v.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    odd = spark.createDataFrame([(60, None), (61, [1.0]), (62, [0.0, 0.0, 0.0]), (63, [1.0, None, 0.0]), (64, [])], "vec_id long, embedding array<double>")
    v = v.unionByName(odd)
    pairs = v.join(q, F.col("vec_id") != F.col("query_id")).select("query_id", "vec_id", F.round(retrieval.cosine(F.col("vector"), F.col("embedding")), 6).alias("similarity"))
    for k in (4, 63):
        want = retrieval.top(pairs, k, ["query_id"], [F.col("similarity").desc(), F.col("vec_id")])
        for got in (retrieval.nearest(q, v, k, 7, 10), retrieval.nearest(q, v, k)):
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    many = spark.range(5000).select(F.col("id").alias("query_id"), F.array(F.cos("id"), F.sin("id"), F.lit(0.0)).alias("vector"))
    assert retrieval.nearest(many, v, 2).count() == 10000
    pages = ids.select(F.concat(F.lit("p"), "id").alias("slug"), F.col("id").cast("string").alias("title"), F.lit("7 x").alias("content"))
    asked = ids.select(F.col("id").alias("query_id"), F.col("id").cast("string").alias("query"))
    want = sorted(map(tuple, retrieval.shortcut(asked, pages).collect()))
    assert want and sorted(map(tuple, retrieval.shortcut(asked, pages, turn_bytes=500).collect())) == want
    assert sorted(map(tuple, retrieval.blocked(pages, asked, F.contains("title", F.col("query")), 7, 10).collect())) == sorted(map(tuple, pages.join(asked, F.contains("title", F.col("query"))).collect()))


def test_hybrid_takes_every_step(spark):
    lines = spark.createDataFrame([(1, "a", "alpha beta"), (2, "a", "alpha"), (3, "b", "gamma"), (4, "b", "alpha beta")], "chunk_id long, title string, content string")
    queries = spark.createDataFrame([(1, "alpha beta"), (2, "manual")], "query_id long, query string")
    words = lambda c: F.split(c, " ")
    terms = queries.select("query_id", F.explode(words("query")).alias("term"))
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0])], "query_id long, vector array<double>")
    vectors = spark.createDataFrame([(1, [0.0, 1.0]), (3, [1.0, 0.0]), (4, [1.0, 0.0])], "chunk_id long, embedding array<double>")
    pages = spark.createDataFrame([("m", "The Manual", "x"), ("n", "y", "a manual")], "slug string, title string, content string")
    posted = retrieval.posting_lists(lines, words("content"), scope="title")
    out = retrieval.hybrid(queries, terms, asked, pages, spark.createDataFrame([(4,)], "chunk_id long"), posted, vectors, lines, lambda q, c: retrieval.jaccard(words(q), words(c)))
    found = [(r.query_id, r.chunk_id, r.slug, r.source, r.score) for r in out.orderBy("query_id", "rank").collect()]
    assert found == [(1, 1, None, "both", 1.0), (1, 2, None, "bm25", 0.5), (1, 3, None, "vector", 0.0), (2, None, "m", "page", 0.7), (2, None, "n", "page", 0.4)]


def test_weighted_health_golden(spark):
    now = datetime.datetime(2024, 1, 1)
    rows = spark.createDataFrame([(1, 1, "attendance", 80.0, now), (1, 2, "data_delay", 60.0, now), (1, 0, "attendance", 1.0, now)], "project_id long, metric_id long, indicator_type string, value double, recorded_at timestamp")
    r = analytics.weighted_health(rows).first()
    assert (r.score, r.level, r.alerts, r.completeness) == (70.9, "critical", 2, 0.5)


def test_items_and_upsert(spark):
    items = spark.createDataFrame([(1, " a ", "x", True, 1.5), (2, "A", "X ", True, 0.5), (3, None, " ", True, 0.5), (4, None, "y", False, -1.0)], "item_id long, category string, description string, flag boolean, confidence double")
    out = {r.item_id: (r.category, r.confidence) for r in maintenance.normalise_items(items).collect()}
    assert out == {1: ("a", 1.0), 4: ("general", 0.0)}
    state = lambda rows: spark.createDataFrame(rows, "k long, version int, v string")
    merged = maintenance.upsert(state([(1, 1, "a"), (2, 5, "b")]), state([(1, 1, "c"), (2, 4, "d"), (3, 1, "e")]), ["k"], "version")
    assert {(r.k, r.v) for r in merged.collect()} == {(1, "c"), (2, "b"), (3, "e")}


def test_trees_of_any_depth_and_cycles(spark):
    tree = lambda rows: spark.createDataFrame(rows, "session_id long, node_id long, parent_id long")
    chain = [(1, k, k - 1 if k else None) for k in range(36)]
    found = maintenance.tree_levels(tree([*chain, (2, 0, None), (2, 5, 4), (2, 6, 5)])).collect()
    assert sorted((r.session_id, r.node_id, r.depth) for r in found) == [*[(1, k, k) for k in range(36)], (2, 0, 0)]
    assert maintenance.tree_levels(tree([])).isEmpty()
    with pytest.raises(ValueError):
        maintenance.tree_levels(tree([(1, 0, None), (1, 1, 2), (1, 2, 1), (1, 3, 2)])).collect()


def test_redaction_round_trip(spark):
    text = "card 6222020200112233445 id 11010519900307123X tel 13812345678 mail a.b@c.org ¥1,200.50 Secret Project [$$_EMAIL_1]"
    safe, found = redaction.redact_one(text, ["Secret", "Secret Project"])
    assert not any(x in safe for x in ("6222", "1101", "138", "a.b@", "1,200", "Secret"))
    assert "[$$_EMAIL_2]" in safe and found["[$$_TERM_1]"] == "Secret Project"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    back = {r.doc_id: r.restored for r in redaction.restore(redaction.redact_texts(docs, ["Secret"])).collect()}
    assert back == {1: text, 2: "", 3: ""}


def test_damaged_placeholders_are_restored(spark):
    found = {"[$$_ID_1]": "A", "[$$_ID_11]": "B [$$_ID_1]", "[$$_EMAIL_2]": "c@d"}
    assert redaction.restore_one("[ $$_id_1 ] [$$_ID_11][$$ _ Email_2] [$$_ID_3] [$_ID_1]", found) == "A B [$$_ID_1]c@d [$$_ID_3] [$_ID_1]"
    rows = spark.createDataFrame([(1, "x [$$_id_1]", {"[$$_ID_1]": "A"}), (2, None, None), (3, "[$$_ID_1]", None)], "k long, safe_text string, found map<string,string>")
    assert sorted((r.k, r.restored) for r in redaction.restore(rows).collect()) == [(1, "x A"), (2, None), (3, "[$$_ID_1]")]


def test_rate_limit_counts_accepted_only(spark):
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    calls = spark.createDataFrame([(1, k, at(s)) for k, s in enumerate((0, 10, 20, 61, 65, 130))], "session_id long, call_id long, started_at timestamp")
    assert [r.accepted for r in logs.rate_limit(calls, 2).orderBy("call_id").collect()] == [True, True, False, True, False, True]


def test_grounding_of_claims(spark):
    known = "金蝶云星空支持多组织架构"
    rows = [(1, "你好，世界和平。", known), (1, "金蝶云星空支持多组织架构。", known), (2, "谢谢你的问题。", known), (3, "没有上下文。", ""), (4, "金蝶不支持云星", known), (5, "abc 无法 x", known), (6, "金蝶不支持云星", known + "，不支持云")]
    s = spark.createDataFrame(rows, "answer_id long, sentence string, context string")
    x = F.col("sentence")
    bigrams = F.filter(F.transform(F.sequence(F.lit(1), F.length(x) - 1), lambda i: F.substring(x, i, F.lit(2))), lambda g: g.rlike("^[一-龥]{2}$"))
    checked = verification.grounding(s, bigrams, share=0.4)
    assert [r.supported for r in checked.orderBy("answer_id", "sentence").collect()] == [None, True, None, False, False, False, True]
    out = {r.answer_id: (r.ratio, r.passed) for r in verification.grounding_verdict(checked, context="context").collect()}
    assert out == {1: (1.0, True), 2: (1.0, True), 3: (0.5, True), 4: (0.0, False), 5: (0.0, False), 6: (1.0, True)}


def test_verification_report(spark):
    rows = [(1, "citation", True, 1.0), (1, "grounding", True, 0.9), (2, "citation", False, 0.2), (2, "grounding", False, 0.1), (3, "citation", True, 1.0), (3, "grounding", False, 0.6)]
    out = {r.answer_id: (r.level, r.labels) for r in verification.report(spark.createDataFrame(rows, "answer_id long, check_name string, passed boolean, confidence double")).collect()}
    assert out == {1: ("confirmed", ""), 2: ("failed", "citation_missing,not_grounded,low_confidence"), 3: ("needs_review", "not_grounded")}


def test_transcripts(spark):
    assert one(spark, transcript.collapse_repeats, "然后然后我好好好想那个那个那个") == "然后我好好想那个"
    assert one(spark, transcript.restore_marks, "我们先看看但是没有时间") == "我们先看看，但是没有时间。"
    assert one(spark, transcript.merge_short, "这是一个比较长的句子内容。短句。另一个也足够长的句子在这里。") == "这是一个比较长的句子内容，短句。另一个也足够长的句子在这里。"
    assert one(spark, transcript.tidy_blanks, "中 文 字  ok  x\n\n y ") == "中文字 ok x\ny"
    assert one(spark, transcript.clean_transcript, "") == ""


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = _next_row(row, i, x, b)
    return row[-1]


def _next_row(row, i, x, b):
    new = [i]
    for j, y in enumerate(b, 1):
        new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
    return new


def test_pairs_of_hot_groups_are_all_there(spark):
    members = spark.createDataFrame([("p", "hot", f"s{k:03d}") for k in range(60)] * 2 + [("p", "one", "s001"), ("q", "hot", "s002"), ("q", "hot", "s001")], "project_id string, group string, slug string")
    found = sorted(map(tuple, pairs.pairs_within(members, ["project_id", "group"], "slug", unit=7).collect()))
    assert found == sorted([("p", "hot", f"s{a:03d}", f"s{b:03d}") for b in range(60) for a in range(b)] + [("q", "hot", "s001", "s002")])
    assert graph.co_occurrence_edges(members, "tag").count() == 60 * 59 // 2 + 1
    assert graph.co_occurrence_edges(members, "tag", 50).count() == 50 * 49 // 2 + 1
    pages = members.where("group = 'hot'").distinct().select("project_id", "slug", F.array("group").alias("tags"), F.array().cast("array<string>").alias("sources"), F.array().cast("array<string>").alias("wikilinks"))
    assert graph.build_graph(pages).count() == 60 * 59 // 2 + 1 and graph.build_graph(pages, 50).count() == 50 * 49 // 2 + 1


def test_fuzzy_duplicates_match_brute_force(spark):
    random.seed(11)
    texts = {"".join(random.choice("ab c") for _ in range(random.randint(0, 12))) for _ in range(150)} | {"aaaa", "aaab", "aaaaaaaa", "aaaaaaab", "", "x", "xy"}
    rows = [(k, k % 2, x) for k, x in enumerate(sorted(texts))] + [(1000, 0, None), (1001, 1, "aaaa")]
    made = spark.createDataFrame(rows, "id long, b int, x string")
    for most in (0.2, 0.3):
        first = {}
        for k, b, x in rows:
            if x is not None:
                first.setdefault((b, x), k)
        want = {(min(i, j), max(i, j)) for (b, x), i in first.items() for (c, y), j in first.items() if b == c and x != y and edit_distance(x, y) <= max(len(x), len(y)) * most}
        assert {tuple(r) for r in pairs.fuzzy_duplicates(made, F.col("b"), "id", "x", most).collect()} == want


def test_semantic_duplicates_match_brute_force(spark):
    random.seed(12)
    rows = [(k % 2, k, [random.gauss(0, 1) for _ in range(3)]) for k in range(60)] + [(0, 100, None), (0, 101, [0.0] * 3), (0, 102, [1.0, 2.0]), (None, 103, [1.0] * 3), (1, 104, [1.0, None, 2.0])]
    made = spark.createDataFrame(rows, "project_id long, vec_id long, embedding array<double>")
    a, b = made.select("project_id", F.col("vec_id").alias("keep"), F.col("embedding").alias("x")), made.select("project_id", F.col("vec_id").alias("drop"), F.col("embedding").alias("y"))
    want = a.join(b, "project_id").where("keep < drop").select("project_id", "keep", "drop", F.round(retrieval.cosine(F.col("x"), F.col("y")), 6).alias("s")).where("s > 0.8")
    for numbers in (20, 1 << 20):
        assert sorted(map(tuple, maintenance.semantic_duplicates(made, 0.8, numbers).collect())) == sorted(map(tuple, want.collect()))


def test_semantic_duplicates_visit_near_cells_only(spark):
    """Clustered vectors: all pairs are found, few are multiplied."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 12))
    rows = [(k % 2, k, (centres[k % 40] + 0.15 * rng.normal(size=12)).tolist()) for k in range(800)] + [(0, 900, [1.0, 2.0]), (0, 901, [1.0, 2.0]), (0, 902, [0.0] * 12)]
    made = spark.createDataFrame(rows, "project_id long, vec_id long, embedding array<double>")
    a, b = made.select("project_id", F.col("vec_id").alias("keep"), F.col("embedding").alias("x")), made.select("project_id", F.col("vec_id").alias("drop"), F.col("embedding").alias("y"))
    for least in (0.92, 0.5):
        want = a.join(b, "project_id").where("keep < drop").select("project_id", "keep", "drop", F.round(retrieval.cosine(F.col("x"), F.col("y")), 6).alias("s")).where(F.col("s") > least)
        for numbers in (1 << 9, 1 << 20):
            assert sorted(map(tuple, maintenance.semantic_duplicates(made, least, numbers).collect())) == sorted(map(tuple, want.collect()))
    placed = maintenance.placed_in_cells(made.withColumnRenamed("embedding", "v"), 0.92)
    sizes = placed.groupBy("project_id", "cell").agg(F.count_if("home").alias("m"), F.count("*").alias("n")).collect()
    assert sum(r.m * (r.m - 1) // 2 + r.m * (r.n - r.m) for r in sizes) < 0.25 * 2 * (400 * 399 // 2)


def test_running_totals_of_any_key(spark):
    rows = [(k % 3 if k % 7 else None, k * 37 % 101, k % 5) for k in range(300)]
    made = spark.createDataFrame(rows, "g long, at long, n long").repartition(5)
    out = analytics.running_total(made, ["g"], [F.col("at"), F.col("n")], "n", "before").collect()
    assert len(out) == 300
    for r in out:
        less = sum(n for g, at, n in rows if g == r.g and (at, n) < (r.at, r.n))
        same = sum(n for g, at, n in rows if g == r.g and (at, n) == (r.at, r.n))
        assert less <= r.before <= less + same


def test_change_ratio_of_long_texts_is_exact(spark):
    long = "".join(chr(97 + k * k % 23) for k in range(6000))
    ratio = lambda a, b, cut=None: spark.createDataFrame([(a, b)], "a string, b string").select(t.change_ratio(F.col("a"), F.col("b"), cut)).first()[0]
    assert ratio(long, "!" + long) == pytest.approx(1 / 6001) and ratio(long, "!" + long, 5000) > 0.5
    assert ratio("", "") == 0.0 and ratio("a" * 6000, "a" * 5999 + "b", 5000) == pytest.approx(1 / 6000)


def test_ingestion_happens_once_over_runs(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "state")
    put = lambda rows: spark.createDataFrame(rows, "source string, text string").coalesce(1).write.mode("append").parquet(source)
    seen = []

    def run():
        stream = streams.tail(spark, source, "source string, text string").withColumn("sha", F.sha2("text", 256))
        done = streams.ingest_once(stream, "t", lambda df: seen.append(df.count()) or df.select("source", "text"), ["source", "sha"], folder)
        return sorted(map(tuple, done.collect()))

    put([("a", "1"), ("a", "1"), ("b", "1")])
    assert run() == [("a", "1"), ("b", "1")]
    put([("a", "1"), ("a", "2")])
    assert run() == [("a", "1"), ("a", "2"), ("b", "1")] and run() == [("a", "1"), ("a", "2"), ("b", "1")]
    assert sum(seen) == 3


def test_ingestion_of_an_empty_source_and_within_a_watermark(spark, tmp_path):
    schema = "source string, text string, at timestamp"
    (tmp_path / "in").mkdir()
    process = lambda df: df.select("source", "text")
    made = streams.ingest_once(streams.tail(spark, str(tmp_path / "in"), schema), "t", process, ["source", "text"], str(tmp_path / "none"))
    assert made.columns == ["source", "text"] and made.isEmpty()
    at = lambda d: datetime.datetime(2024, 1, d)
    run = lambda: sorted(map(tuple, streams.ingest_once(streams.tail(spark, str(tmp_path / "in"), schema), "t", process, ["source"], str(tmp_path / "some"), ("at", "2 days")).collect()))
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    put([("a", "1", at(1)), ("b", "1", at(2))])
    assert run() == [("a", "1"), ("b", "1")]
    put([("a", "2", at(2)), ("c", "1", at(9))])
    assert run() == [("a", "1"), ("b", "1"), ("c", "1")]  # a was seen
    put([("a", "3", at(9))])
    assert run() == [("a", "1"), ("a", "3"), ("b", "1"), ("c", "1")]  # a has been forgotten


def test_index_grows_by_batches(spark, tmp_path):
    """Two runs and a batch that runs again equal an index built at once; an empty source gives an empty one."""
    schema = "chunk_id long, content string"
    source, folder = str(tmp_path / "in"), str(tmp_path / "state")
    (tmp_path / "in").mkdir()
    fields = lambda: {"content": F.split("content", " ")}
    grow = lambda to: streams.ingest_index(streams.tail(spark, source, schema), lambda df: df, fields, ["content"], to, slots=3, buckets=2)
    asked = spark.createDataFrame([(1, "a"), (1, "c"), (2, "b")], "query_id long, term string")
    hits = lambda made: sorted(map(tuple, index.search(made, asked, 3).collect()))
    assert hits(grow(str(tmp_path / "none"))) == []
    first, second = [(1, "a b"), (2, "a a c"), (1, "a b")], [(4, "b c c"), (5, "a a c"), (6, "d a")]
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    put(first)
    grow(folder)
    put(second)
    made = grow(folder)
    whole = index.build_index(spark.createDataFrame([(1, "a b"), (2, "a a c"), (4, "b c c"), (6, "d a")], schema), fields(), slots=3, buckets=2)
    assert hits(made) == hits(whole) and hits(whole)
    index.build_index(spark.createDataFrame([(4, "b c c"), (6, "d a")], schema), fields(), path=f"{folder}/index", batch=1, slots=3, buckets=2)  # runs again
    assert hits(index.open_index(spark, f"{folder}/index", 2, 3)) == hits(whole)


def test_alarms_forget_and_know_steps(spark, tmp_path):
    schema = "session_id long, step date, tool string, args string, at timestamp"
    day = lambda d: datetime.date(2024, 1, d)
    at = lambda d, h=0: datetime.datetime(2024, 1, d, h)
    source, out, log = (str(tmp_path / x) for x in ("in", "out", "log"))

    def run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        calls = streams.tail(spark, source, schema).withWatermark("at", "1 hour")
        alarms = streams.repeated_call_alarms(calls, 1, keep_ms=3_600_000)
        alarms.writeStream.option("checkpointLocation", log).option("path", out).format("parquet").trigger(availableNow=True).start().awaitTermination()
        return sorted((r.session_id, r.step.day, r.calls) for r in spark.read.schema(alarms.schema).parquet(out).collect())

    assert run([(1, day(1), "t", "x", at(1)), (1, day(2), "t", "x", at(1)), (2, day(1), "t", "x", at(1)), (2, day(1), "t", "x", at(1))]) == [(2, 1, 2)]  # steps of session 1 differ
    assert run([(1, day(1), "t", "x", at(1, 1))]) == [(1, 1, 2), (2, 1, 2)]
    run([(9, day(9), "t", "x", at(9))])  # the watermark moves on, so counts are forgotten
    assert run([(1, day(1), "t", "x", at(9, 1))]) == [(1, 1, 2), (2, 1, 2)]


def test_salvage_and_source_keys(spark):
    broken = 'x [{"a": "}{\\" \\\\"}, {"b": {"c": [1, {"d": 2}]}}, {"e": {"f": 1}'
    assert one(spark, t.whole_objects, broken) == ['{"a": "}{\\" \\\\"}', '{"b": {"c": [1, {"d": 2}]}}']
    assert one(spark, t.whole_objects, "") == [] and one(spark, t.whole_objects, None) is None
    keys = lambda x: one(spark, t.source_keys, x)
    assert keys('[{"source_id": 5, "document_id": 7}, {"source_id": "  ", "document_id": 7}, {"document_id": " x "}, {"source_id": null}, {"source_id": {"a": 1}, "document_id": 2}, {"source_id": 5}]') == ["document_id:2", "document_id:7", "document_id:x", "source_id:5"]
    assert keys("[]") == [] and keys("no json") is None


def test_step_failures_and_rules(spark):
    rows = [("", "x"), (" \n", None), ("all Failed", "x"), ("操作超时了", "x"), ("ok", "y" * 51), ("ok", "y" * 50), ("ok", None), ("fine result", "y" * 99), (None, "x")]
    made = spark.createDataFrame(rows, "o string, e string")
    assert [r[0] for r in made.select(logs.step_failure(F.col("o"), F.col("e"))).collect()] == ["empty", "empty", "word:failed", "word:超时", "short", None, None, None, "empty"]
    rule = lambda k, x: spark.createDataFrame([(k, x)], "k string, x string").select(logs.rule_of(F.col("k"), F.col("x"))).first()[0]
    assert rule("exhausted", "结果为空") == logs.RULES["empty"] and rule("exhausted", "timeout, not supported") == logs.RULES["timeout"]
    assert rule("exhausted", "z" * 99) == logs.RULES["exhausted"] + "z" * 80 and rule("replan", "a") == logs.RULES["replan"] + "a"
    assert rule("timeout", "a") == logs.RULES["one_timeout"] and rule("odd", "a") == logs.RULES["other"] + "a"
    own = logs.rule_of(F.lit("replan"), F.lit("a"), {**logs.RULES, "replan": "think: "})
    assert spark.range(1).select(own).first()[0] == "think: a"


def test_coverage_and_sign_off(spark):
    required = spark.createDataFrame([("p1", "plan", True), ("p1", "final report", True), ("p1", "extra", False), ("p2", "plan", True), ("p1", "", True)], "phase string, name string, required boolean")
    files = spark.createDataFrame([("p1", "d/plan-v1.doc"), ("p1", "d/plan.doc"), ("p1", "d/report.md"), ("p3", "x.md")], "phase string, path string")
    out = {(r.phase, r.name): (r.status, r.path) for r in maintenance.coverage(required, files).collect()}
    assert out[("p1", "plan")] == ("pending", "d/plan-v1.doc") and out[("p1", "final report")] == ("pending", "d/report.md")
    assert out[("p1", "extra")] == ("optional", None) and out[("p2", "plan")] == ("missing", None)
    assert out[("p3", "x.md")] == ("optional", "x.md") and out[("p1", "report.md")][0] == "optional" and len(out) == 8
    cells = spark.createDataFrame([(1, "p1", "plan.doc", "pending"), (2, "p1", "plan-b", "pending"), (3, "p2", "test", "missing"), (4, "p9", "z", "pending")], "cell long, phase string, name string, status string")
    events = spark.createDataFrame([(1, "p1", "plan.md", True), (2, "p1", "plan", False), (3, "p2-x", "a test", True), (4, "p7", "z", True)], "event long, phase string, name string, signed_off boolean")
    got = {r.cell: (r.status, r.signed_off) for r in maintenance.sign_off(cells, events).collect()}
    assert got == {1: ("done", False), 2: ("pending", False), 3: ("done", True), 4: ("pending", False)}


def test_missing_values_and_their_counts(spark):
    rows = spark.createDataFrame([(1, None, "x"), (None, 2, None), (3, 4, None)], "a long, b long, c string")
    rules = [("a", "mark", None), ("a", "fill", 0), ("b", "drop", None), ("c", "fill", "?"), ("c", "drop", None)]
    assert sorted(map(tuple, maintenance.treat_missing(rows, rules).collect())) == [(0, 2, "?", True), (3, 4, "?", False)]
    assert [tuple(r)[0::1][3:] for r in maintenance.missing_counts(rows, rules).orderBy("step").collect()] == [(3, 1), (3, 1), (3, 1), (2, 2), (2, 0)]


def test_profile_match_counts_similarity_and_containment(spark):
    words = lambda x: F.array_distinct(F.filter(F.split(F.lower(x), "[^a-z]+"), lambda w: w != ""))
    q = spark.createDataFrame([(1, "fix the report now"), (2, "unrelated")], "query_id long, text string")
    d = spark.createDataFrame([(1, "the report"), (2, "please fix the report now or later"), (3, "report on many other long things"), (4, "nothing here"), (5, "ix the report n")], "doc_id long, text string")
    out = {(r.query_id, r.doc_id): r.score for r in retrieval.profile_match(q, d, words).collect()}
    assert out == {(1, 1): 2 + 3 * 0.5 + 5, (1, 2): pytest.approx(4 + 3 * 4 / 7 + 5), (1, 3): 1.0, (1, 5): pytest.approx(2 + 3 / 3 + 5)}


def test_postings_count_inside_rows(spark):
    rows = spark.createDataFrame([("a", 1, "x y x x z"), ("a", 2, ""), ("b", 3, "y")], "project_id string, chunk_id long, content string")
    lists = retrieval.posting_lists(rows, F.filter(F.split("content", " "), lambda w: w != ""))
    assert sorted((r.chunk_id, r.term, r.tf, r.dl) for r in retrieval.postings(lists).collect()) == [(1, "x", 3, 5), (1, "y", 1, 5), (1, "z", 1, 5), (3, "y", 1, 1)]
    held = retrieval.postings(retrieval.with_phrases(rows, lists, spark.createDataFrame([("Y X",), ("q q",)], "phrase string"), F.col("content"))).where("term = 'y x'").collect()
    assert [(r.chunk_id, r.dl, r.tf) for r in held] == [(1, 5, 1)] and retrieval.with_phrases(rows, lists, spark.createDataFrame([], "phrase string"), F.col("content")).count() == 3


def test_bm25_matches_plain_loops(spark):
    """Ties, chunks of many batches and weights in several turns."""
    random.seed(13)
    words = [f"w{k}" for k in range(12)]
    texts = {k: [random.choice(words) for _ in range(random.randint(0, 6))] for k in range(300)}
    lists = retrieval.posting_lists(spark.createDataFrame([("a", k, x) for k, x in texts.items()], "project_id string, chunk_id long, t array<string>"), F.col("t"))
    asked = {q: random.sample(words + ["none"], 3) for q in range(9)}
    made = spark.createDataFrame([(q, w) for q, ws in asked.items() for w in ws] + [(99, "none"), (None, "w1")], "query_id long, term string")
    full = {k: x for k, x in texts.items() if x}
    mean, df = sum(map(len, full.values())) / len(full), {w: sum(w in x for x in full.values()) for w in words}
    want = []
    for q, ws in asked.items():
        scores = []
        for k, x in full.items():
            total = sum(math.log(1 + (len(full) - df[w] + 0.5) / (df[w] + 0.5)) * x.count(w) * 2.2 / (x.count(w) + 1.2 * (0.25 + 0.75 * len(x) / mean)) for w in ws if w in x)
            if total:
                scores.append((-round(total, 6), k))
        want += [(q, k, -s, n + 1) for n, (s, k) in enumerate(sorted(scores)[:7])]
    for most in (1 << 18, 5):
        out = retrieval.bm25(made, lists, 7, most_weights=most).collect()
        assert sorted((r.query_id, r.chunk_id, r["rank"]) for r in out) == sorted((q, k, n) for q, k, _, n in want)
        assert all(abs(r.score - s) < 2e-6 for r, (_, _, s, _) in zip(sorted(out, key=lambda r: (r.query_id, r["rank"])), sorted(want, key=lambda w: (w[0], w[3]))))
    assert retrieval.bm25(made, lists.limit(0)).isEmpty() and retrieval.bm25(made.limit(0), lists).isEmpty()


def test_newest_places_and_coverage_of_tests(spark):
    skills = spark.createDataFrame([(f"s{k}", "all" if k % 3 == 0 else f"p{k % 2}", k) for k in range(20)] + [("s1", "all", 1)], "skill string, phase string, listed long")
    out = analytics.recommend_for_phases(skills, spark.createDataFrame([("p1",), ("p5",)], "phase string")).orderBy("phase", "place").collect()
    assert [r.skill for r in out if r.phase == "p1"] == ["s1", "s5", "s7", "s11", "s13", "s17"]
    assert [r.skill for r in out if r.phase == "p5"] == ["s0", "s1", "s3", "s6", "s9", "s12"]
    req = spark.createDataFrame([(1, 1), (1, 2), (2, 3)], "project_id long, requirement long")
    tests = spark.createDataFrame([(1, 1, 10, "pass"), (1, 1, 11, "fail"), (1, 2, 12, "not-run")], "project_id long, requirement long, test_id long, status string")
    assert sorted(map(tuple, analytics.test_coverage(req, tests).collect())) == [(1, 0.5, 1, 1, 1, 0), (2, 0.0, 0, 0, 0, 0)]
    assert [r.test_id for r in analytics.open_issues(tests, tests.where("false")).collect()] == [11]
    facts = spark.createDataFrame([(1, "tests", 1, 1), (1, "tests", 0, 1), (1, "defects", 0, 0)], "project_id long, kind string, hits long, total long")
    assert tuple(analytics.closing_rates(facts).first()) == (1, None, 0.5, None, None)


def test_a_text_file_of_any_size_is_read_in_splits(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "big.txt").write_text("".join(f"line {k} é\n" for k in range(50_000)), encoding="utf-8")
    (tmp_path / "bad.md").write_bytes(b"fine\n\xff\xfe\n")
    (tmp_path / "x.bin").write_bytes(b"no text\n")
    (tmp_path / "cr.log").write_bytes(b"a\rb\n\nlast")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        rows, errors = files.scan_text_lines(spark, str(tmp_path))
        found = rows.withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    big = [r for r in found if r.path.endswith("big.txt")]
    assert len({r.task for r in big}) > 4 and sorted(r.line for r in big) == sorted(f"line {k} é" for k in range(50_000))
    assert [r.line for r in found if r.path.endswith("cr.log")] == ["a\rb", "", "last"] and not any(r.path.endswith(("bad.md", "x.bin")) for r in found)
    whole, bad = files.scan_text_files(spark, str(tmp_path))
    assert [r.path.split("/")[-1] for r in errors.collect()] == [r.path.split("/")[-1] for r in bad.collect()] == ["bad.md"]
    assert {r.size for r in errors.collect()} == {r.size for r in bad.collect()}


def test_alarms_call_python_once_a_bucket(spark, tmp_path):
    """Keys with nulls, quotes and large numbers are told apart, and counted over batches; what is forgotten in a bucket does not take its other keys along."""
    schema = "session_id long, step date, tool string, args string, at timestamp"
    source, out, log = (str(tmp_path / x) for x in ("in", "out", "log"))
    day, at = datetime.date(2024, 1, 1), lambda d: datetime.datetime(2024, 1, d)
    odd = [(2**62 + k, None if k % 2 else day, None if k % 3 else 't"\\', [None, "", "null"][k % 3]) for k in range(6)]

    def run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        alarms = streams.repeated_call_alarms(streams.tail(spark, source, schema).withWatermark("at", "1 hour"), 1, keep_ms=86_400_000, buckets=1)
        alarms.writeStream.option("checkpointLocation", log).option("path", out).format("parquet").trigger(availableNow=True).start().awaitTermination()
        return {(*r[:4], r.calls) for r in spark.read.schema(alarms.schema).parquet(out).collect()}

    assert run([(*k, at(1)) for k in odd] + [(*odd[0], at(1))]) == {(*odd[0], 2)}
    assert run([(*odd[1], at(2)), (*odd[2], at(1))]) == {(*odd[0], 2), (*odd[1], 2), (*odd[2], 2)}
    run([(9, day, "t", "x", datetime.datetime(2024, 1, 2, 23))])  # by now all but odd[1] and this are forgotten
    assert run([(*odd[1], at(3)), (*odd[3], at(3))]) == {(*odd[0], 2), (*odd[1], 2), (*odd[2], 2), (*odd[1], 3)}


def test_pairs_of_large_groups_are_listed_once_without_a_shuffle_of_pairs(spark, capsys):
    """Classes of equal large groups, blocks of classes, small groups beside large ones, items in no pair, nulls."""
    import itertools

    rng = random.Random(5)
    rows = {(p, g, f"s{k}") for p in (1, 2) for k in range(120) for g in {f"a{k % 3}", f"b{rng.randrange(4)}", f"c{rng.randrange(40)}", f"d{k if k % 7 else 0}"}}
    made = spark.createDataFrame([*rows, *rows, (1, None, "s1"), (1, "a0", None), (None, "a0", "s5")], "project_id long, group string, slug string")
    found = pairs.pairs_once(made, ["project_id"], "group", "slug", small=10, unit=7, task_rows=100)
    of = {}
    for p, g, s in rows:
        of.setdefault((p, g), set()).add(s)
    want = sorted({(p, *sorted(two)) for (p, _), s in of.items() for two in itertools.combinations(s, 2)})
    assert sorted((r.project_id, r.x, r.y) for r in found.collect()) == want

    whole = pairs.pairs_once(spark.range(2000).select(F.lit(1).alias("project_id"), (F.col("id") % 2).alias("group"), F.col("id").alias("slug")), ["project_id"], "group", "slug", task_rows=1 << 17)
    sizes = [r["count"] for r in whole.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 2 * 1000 * 999 // 2 and max(sizes) < sum(sizes) / 2


def test_pairs_leave_a_unit_item_by_item(spark):
    """The two steps that expand a unit are not fused, so a task holds the pairs of one item as rows; a task has many pairs, whatever the members' dealing."""
    made = spark.range(2000).select(F.lit(1).alias("project_id"), (F.col("id") % 2).alias("group"), F.col("id").alias("slug"))
    found = pairs.pairs_once(made, ["project_id"], "group", "slug", task_rows=1 << 10, task_pairs=1 << 20)
    nodes = [line.strip(" :+-|").lstrip("*(0123456789) ").split("(")[0].split()[0] for line in found._jdf.queryExecution().executedPlan().toString().splitlines()]
    first, second = [i for i, n in enumerate(nodes) if n == "Generate"][:2]
    assert "Coalesce" in nodes[first:second]
    sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 2 * 1000 * 999 // 2 and len(sizes) == 1


def _peak_mb(work):
    import tracemalloc

    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_scoring_and_comparing_hold_strips_only():
    """Memory of a task does not grow with how many queries ask a frequent term, nor with the queries of a block."""
    import types

    import pyarrow as pa

    asked, terms, rows = 400, 20, 4000
    weights = pa.table({"query_id": np.repeat(np.arange(asked), terms), "term": [f"t{k}" for k in range(terms)] * asked, "idf": np.linspace(0.1, 1, asked * terms)})
    lists = pa.array([[{"term": f"t{k}", "tf": 1 + (r + k) % 3} for k in range(terms)] + [{"term": "other", "tf": 1}] for r in range(rows)], pa.list_(pa.struct([("term", pa.string()), ("tf", pa.int64())])))
    batch = pa.RecordBatch.from_arrays([pa.array(range(rows)), pa.array([terms + 1 + r % 5 for r in range(rows)]), lists], ["chunk_id", "dl", "terms"])
    score = lambda **most: pa.Table.from_batches(retrieval._scorer(types.SimpleNamespace(value=weights), "chunk_id", 5, 1.2, 0.75, 22.0, **most)(iter([batch])))
    assert score() == score(at_once=1 << 12) and score().num_rows == 5 * asked
    assert _peak_mb(score) < 250  # a bounded number of hits of terms by queries at once

    rng = np.random.default_rng(0)
    vectors = lambda n: pa.array(list(rng.normal(size=(n, 4))), pa.list_(pa.float64()))
    queries, many = pa.table({"query_id": range(300), "v": vectors(300)}), pa.table({"vec_id": range(16384), "v": vectors(16384)})
    assert retrieval._unit_nearest(queries, many, 5) == retrieval._unit_nearest(queries, many, 5, at_once=300)
    assert _peak_mb(lambda: retrieval._unit_nearest(queries, many, 5)) < 100


def test_semantic_duplicates_leave_a_task_strip_by_strip(spark):
    """Many pairs over a low bound: those of a unit are handed on in several batches, none lost."""
    made = spark.range(200).select((F.col("id") % 2).alias("project_id"), F.col("id").alias("vec_id"), F.array(F.cos("id"), F.sin("id"), F.lit(1.0)).alias("embedding"))
    sets = [sorted(map(tuple, maintenance.semantic_duplicates(made, 0.3, cells=3, most_scores=m).collect())) for m in (1, 500, 1 << 20)]
    a, b = made.alias("a"), made.alias("b")
    want = a.join(b, F.expr("a.project_id = b.project_id and a.vec_id < b.vec_id")).select(F.col("a.vec_id").alias("x"), F.col("b.vec_id").alias("y"), retrieval.cosine(F.col("a.embedding"), F.col("b.embedding")).alias("s")).where("round(s, 6) > 0.3")
    assert sets[0] == sets[1] == sets[2] and [(r[1], r[2]) for r in sets[0]] == sorted(((r.x, r.y) for r in want.collect()), key=lambda p: (p[0] % 2, *p))


def test_vectors_without_clusters_are_not_multiplied(spark):
    """At a low bound they would visit nearly all cells: they share one; visits that are made leave a task in bounded batches."""
    import types

    import pyarrow as pa

    rng = np.random.default_rng(4)
    made = spark.createDataFrame([(k % 2, k, rng.normal(size=16).tolist()) for k in range(1000)] + [(0, 2000, [0.0] * 16)], "project_id long, vec_id long, v array<double>")
    assert maintenance.placed_in_cells(made, 0.3).count() == 1001
    pairs_of = lambda **how: sorted(map(tuple, maintenance.semantic_duplicates(made.withColumnRenamed("v", "embedding"), 0.3, **how).collect()))
    assert pairs_of() == pairs_of(cells=9) == pairs_of(cells=9, unit_numbers=1 << 9) == pairs_of(unit_numbers=1 << 9, most_scores=1 << 10) != []

    centres = rng.normal(size=(256, 16))
    batch = pa.RecordBatch.from_arrays([pa.array([0] * 8000), pa.array(range(8000)), pa.array(list(rng.normal(size=(8000, 16))), pa.list_(pa.float64())), pa.array([255] * 8000, pa.int32())], ["project_id", "vec_id", "v", "cell"])
    visit = maintenance._visitor(types.SimpleNamespace(value=centres / np.linalg.norm(centres, axis=1, keepdims=True)), np.full(256, 3.2), 1.0)
    assert max(b.num_rows for b in visit(iter([batch]))) * 16 <= 1 << 21
    assert _peak_mb(lambda: [b.num_rows for b in visit(iter([batch]))]) < 100


def test_truncation_reads_no_more_than_the_budget_can_hold(spark):
    import time

    made = spark.createDataFrame([("é" + "a b " * 1_000_000,)], "x string").repartition(1)
    began = time.time()
    cut = made.select(t.truncate_to_budget(F.col("x"), 100)).first()[0]
    assert cut == ("é" + "a b " * 100)[: len(cut)] and len(cut) == 347 and time.time() - began < 20
