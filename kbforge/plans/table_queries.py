"""Joins, deduplication, incremental state, logs, verification and window queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import logs, verification as v
from ..operators import lookups as k
from ..operators import maintenance as m
from ..operators.analytics import latest
from ..operators.pairs import fuzzy_duplicates
from ..operators.retrieval import nearest
from .fixtures import CALLS, CHUNKS, calls, chunks, table

_DATE = "2024-01-31"


def _docs(spark, d):
    return table(spark, d, "documents")


def _arrivals(spark, d):
    keyed = _docs(spark, d).select(F.sha2("text", 256).alias("sha256"), (F.col("doc_id") % 5).alias("project_id"), F.col("doc_id").alias("arrival"))
    known = keyed.where("arrival % 4 = 0").select("sha256", "project_id", (F.col("arrival") % 3).alias("chunks"))
    return m.classify_arrivals(keyed, known, ["sha256", "project_id"]).select(F.col("arrival").alias("doc_id"), "state")


def _turns(spark, d):
    return table(spark, d, "conversations")


def _attachments(spark, d):
    """Chunks of documents that are not attachments."""
    out = _docs(spark, d).where("doc_id % 25 = 0").select(F.col("doc_id").alias("document_id"))
    return k.without_documents(chunks(spark, d), out).groupBy("project_id").agg(F.count("*").alias("chunks"))


def _scope(spark, d):
    """Own project or one of the listed further ones."""
    allowed = spark.range(20).select(F.concat(F.lit("src"), "id").alias("own"), F.explode(F.array(F.concat(F.lit("src"), "id"), F.concat(F.lit("src"), (F.col("id") + 1) % 20))).alias("source"))
    return k.in_scope(_docs(spark, d), allowed, "source").groupBy("own").agg(F.count("*").alias("documents"))


def _parents(spark, d):
    """Every third chunk is a child of the one before; hits expand to distinct parents."""
    rows = chunks(spark, d).withColumn("parent_id", F.when(F.col("line_no") % 3 == 2, F.col("chunk_id") - 1))
    return k.expand_to_parents(rows.where(F.contains("content", F.lit("tion"))), chunks(spark, d)).select("chunk_id", "document_id")


def _suggest(spark, d):
    parts = table(spark, d, "part").select(F.concat(F.lit("part-"), "p_partkey").alias("slug"), F.col("p_name").alias("title"))
    words = parts.select(F.substring_index("title", " ", -1).alias("query"), F.lit(None).cast("string").alias("self_slug")).distinct()
    return k.suggest_links(parts, words).select("query", "slug")


def _suggest_own(spark, d):
    """Every fiftieth page asks with its own title, or its slug, and is not suggested to itself."""
    parts = table(spark, d, "part").select("p_partkey", F.concat(F.lit("part-"), "p_partkey").alias("slug"), F.col("p_name").alias("title"))
    query = F.when(F.col("p_partkey") % 100 == 0, F.col("slug")).otherwise(F.col("title"))
    return k.suggest_links(parts, parts.where("p_partkey % 50 = 0").select(query.alias("query"), F.col("slug").alias("self_slug")))


def _work_list(spark, d):
    have = _docs(spark, d).where("doc_id % 2 = 0").select(F.col("doc_id").alias("identity"), F.sha2("text", 256).alias("sha256"))
    want = _docs(spark, d).select(F.col("doc_id").alias("identity"), F.sha2("text", 256).alias("sha256"))
    return k.work_list(want, have).select("identity")


def _cache(spark, d):
    """A document's first letter as the version of its cache entry, words that stand before a colon or semicolon as files."""
    cache = _docs(spark, d).select("doc_id", F.left("text", F.lit(1)).alias("version"), F.regexp_extract_all("text", F.lit("([a-z]+)[,;]"), F.lit(1)).alias("files"))
    return cache.select("doc_id", k.cache_hit(F.col("version"), F.col("files"), "T").alias("hit"))


def _meetings(spark, d):
    o, c, n = table(spark, d, "orders"), table(spark, d, "customer"), table(spark, d, "nation")
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    rows = k.with_assets(rows, table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")
    return rows.select(F.col("o_orderkey").alias("meeting_id"), "c_name", "n_name", F.col("assets").alias("lines"))


def _session_snapshot(spark, d):
    log = k.in_order(calls(spark, d), "session_id", ["started_at", "call_id"], "call_id")
    return log.select("session_id", F.md5(F.array_join(F.transform("values", lambda x: x.cast("string")), ",")).alias("digest"))


def _title_duplicates(spark, d):
    """Conversations of odd id arrive with the first words of their title; even ones of the same remainder are listed, the newest first."""
    titled = m.conversation_titles(_turns(spark, d), 2).withColumn("project_id", F.col("conv_id") % 5)
    listed = titled.where("conv_id % 2 = 0").select("project_id", "title", F.col("conv_id").alias("doc_id"), (F.col("conv_id") % 7).alias("created"))
    return m.recent_title_duplicates(titled.where("conv_id % 2 = 1"), listed, 3).select("conv_id", "title", "duplicate")


def _deliverables(spark, d):
    """Brands as phases: names of listed deliverables and files that hold them, or not."""
    parts = table(spark, d, "part")
    words = t.literals(["ring.doc", "widget", "gear", "large bolt.v2", "none"])
    required = parts.select(F.col("p_brand").alias("phase")).distinct().select("phase", F.posexplode(words).alias("k", "name")).select("phase", "name", (F.col("k") % 2 == 0).alias("required"))
    kind = F.when(F.col("p_size") % 3 == 0, "").when(F.col("p_size") % 3 == 1, ".doc").otherwise(".v2")
    return required, parts.where("p_size < 20").select(F.col("p_brand").alias("phase"), F.concat(F.lit("out/"), F.when(F.col("p_size") % 4 == 0, F.substring_index("p_name", " ", -1)).otherwise(F.col("p_name")), kind).alias("path")).distinct()


def _coverage(spark, d):
    return m.coverage(*_deliverables(spark, d))


def _sign_off(spark, d):
    """Listed deliverables as cells, orders of one clerk number as completed events."""
    cells = _deliverables(spark, d)[0].withColumn("cell", F.concat_ws("/", "phase", "name")).select("cell", "phase", "name", F.lit("pending").alias("status"))
    name = F.element_at(t.literals(["ring", "widget.doc", "bolt", "large bolt", "zzz"]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    events = table(spark, d, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("event"), F.concat(F.lit("Brand#"), F.col("o_custkey") % 30).alias("phase"), name.alias("name"), (F.col("o_orderstatus") == "F").alias("signed_off"))
    return m.sign_off(cells, events)


_MISSING = [("price", "mark", None), ("price", "fill", 0), ("clerk", "drop", None), ("state", "fill", "?")]


def _gaps(spark, d):
    """Orders with gaps."""
    n = F.col("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", F.when(n % 6 > 0, F.round("o_totalprice").cast("long")).alias("price"), F.when(n % 5 > 0, F.col("o_custkey")).alias("clerk"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("state"))


def _step_results(spark, d):
    """Answers as outputs of steps and questions as what was expected; short, empty and failed ones by their text."""
    by = m.Window.partitionBy("conv_id").orderBy("turn")
    first = F.left("text", F.lit(1))
    output = F.when(first == "T", F.left("text", F.lit(8))).when(first == "I", F.lit("  ")).when(first == "E", F.concat("text", F.lit(" Timeout"))).otherwise(F.col("text"))
    rows = _turns(spark, d).withColumns({"expected": F.lag("text").over(by), "output": output})
    rows = rows.withColumn("reason", logs.step_failure(F.col("output"), F.col("expected"))).select(F.col("conv_id").alias("session_id"), "turn", "reason", F.col("reason").isNotNull().alias("failed"))
    return logs.failure_streaks(rows, 2, ["turn"]).select(F.col("session_id").alias("conv_id"), "turn", "reason", "streak", "replan")


def _constant_scores(spark, d):
    """Parts by a title hit and by a type hit, each with its constant score, as a distinct union."""
    p = table(spark, d, "part")
    hit = lambda c, word, score: p.where(F.contains(F.lower(c), F.lit(word))).select("p_brand", "p_name", F.lit(score).alias("score"))
    return hit("p_name", "ring", 1.0).unionByName(hit("p_type", "small", 0.5)).unionByName(hit("p_name", "small", 1.0)).distinct()


def _scope_items(spark, d):
    return k.search_items(table(spark, d, "part"), "Ring", ["p_name", "p_brand"], "p_brand", [F.col("p_partkey")], 3).select("p_brand", "p_partkey", "p_name")


def _identity(spark, d):
    return table(spark, d, "pages").select("page_id", k.identity_of(F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("id-"), "page_id")), F.col("url")).alias("identity"))


def _awaiting(spark, d):
    done = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return k.awaiting(table(spark, d, "orders").where("o_orderstatus = 'F'"), done, "o_orderkey").select("o_orderkey")


def _retention(spark, d):
    return m.retain_newest(_docs(spark, d), ["source"], [F.col("doc_id").desc()], 20).select("doc_id", "source")


def _upsert(spark, d):
    cur = _docs(spark, d).select("doc_id", F.lit(1).alias("version"), F.lit("old").alias("state"))
    new = _docs(spark, d).where("doc_id % 3 = 0").select((F.col("doc_id") * 2).alias("doc_id"), (F.col("doc_id") % 2 * 2).cast("int").alias("version"), F.lit("new").alias("state"))
    return m.upsert(cur, new, ["doc_id"], "version").select("doc_id", "state")


_MAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+"


def _drift(spark, d):
    """The index was built before e-mail addresses were taken out of the texts, and lacks some documents."""
    now = _docs(spark, d).select("doc_id", F.sha2(F.regexp_replace("text", _MAIL, ""), 256).alias("sha"))
    then = _docs(spark, d).where("doc_id % 13 <> 0").select("doc_id", F.sha2("text", 256).alias("sha"))
    return m.drift(now, then, "doc_id", "sha")


def _items(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("item_id"), F.when(F.col("p_size") > 5, F.col("p_brand")).alias("category"), F.concat(F.lit(" "), "p_name").alias("description"), (F.col("p_size") % 2 == 0).alias("flag"), (F.col("p_retailprice") / 1000).alias("confidence"))
    return m.normalise_items(rows).select("item_id", "category", "description", "flag", F.round("confidence", 6).alias("confidence"))


def _fuzzy(spark, d):
    return fuzzy_duplicates(table(spark, d, "part"), F.col("p_brand"), "p_partkey", "p_name", 0.3)


def _standardise(spark, d):
    date = F.coalesce(F.try_to_timestamp(F.date_format("o_orderdate", "yyyy/MM/dd"), F.lit("yyyy-MM-dd")), F.try_to_timestamp(F.date_format("o_orderdate", "yyyy/MM/dd"), F.lit("yyyy/MM/dd")))
    return table(spark, d, "orders").select("o_orderkey", F.to_date(date).alias("day"), F.round("o_totalprice", 0).cast("long").alias("price"), F.lower(F.regexp_extract("o_orderpriority", "-(.*)$", 1)).alias("priority"))


def _stale(spark, d):
    age = F.datediff(F.lit(_DATE).cast("date"), F.to_date("ts"))
    action = F.when(F.col("event_type") == "error", "remove").when(F.col("event_type") == "view", "reindex").otherwise("update")
    return table(spark, d, "events").where(age > 20).groupBy(action.alias("action")).agg(F.count("*").alias("n"), F.max(age).cast("long").alias("oldest"))


def _candidates(spark, d):
    p = table(spark, d, "part").select(F.concat(F.lit("part-"), "p_partkey").alias("slug"), "p_name", "p_type", "p_partkey")
    pages = p.where("p_partkey % 3 <> 0").select("slug", F.when(F.col("p_partkey") % 5 == 0, "").otherwise(F.col("p_name")).alias("content"))
    new = p.select("slug", F.when(F.col("p_partkey") % 2 == 0, F.concat("p_name", F.lit("s"))).otherwise(F.col("p_type")).alias("text"))
    return m.classify_candidates(new, pages, t.change_ratio(F.lower("text"), F.lower("content")))


def _approve(spark, d):
    return _candidates(spark, d).groupBy(F.when(F.col("status") == "auto", "approved").otherwise("skipped").alias("action")).agg(F.count("*").alias("n"))


def _transition(spark, d):
    """Nations as phases of regions, some begun or ended before; a region's target follows from the number of its customers."""
    nation, key = table(spark, d, "nation"), F.col("n_nationkey").cast("int")
    at = F.row_number().over(m.Window.partitionBy("n_regionkey").orderBy("n_nationkey")) - 1
    started = F.when(key % 3 != 0, F.date_add(F.lit("2023-01-01").cast("date"), key))
    ended = F.when(key % 4 == 0, F.date_add(F.lit("2023-06-01").cast("date"), key))
    project = F.col("n_regionkey").cast("long").alias("project_id")
    phases = nation.select(project, at.cast("long").alias("phase_index"), started.alias("started"), ended.alias("ended"))
    targets = table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(project).agg((F.count("*") % 5).alias("target"))
    return m.phase_transition(phases, targets, F.lit(_DATE).cast("date")).select("project_id", "phase_index", "status", "started", "ended")


def _queue(spark, d):
    state = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "click", "done").otherwise("pending")
    log = table(spark, d, "events").select((F.col("user_id") % 20).alias("project_id"), F.get_json_object("props", "$.k").cast("long").alias("item"), state.alias("state"), "ts", "event_id")
    return m.queue_state(log)


def _cascade(spark, d):
    gone = _docs(spark, d).where("doc_id % 11 = 0").select(F.col("doc_id").alias("document_id"))
    return k.without_documents(chunks(spark, d), gone).groupBy("document_id").agg(F.count("*").alias("chunks"))


def _versions(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey")
    old = o.where("o_orderkey % 2 = 0").groupBy("o_custkey").agg(F.count("*").alias("version"))
    return m.append_versions(o.where("o_orderkey % 2 = 1"), old, "o_custkey", [F.col("o_orderkey")])


def _sync(spark, d):
    old = table(spark, d, "part").select(F.col("p_brand").alias("session"), F.col("p_partkey").alias("old_id"), F.col("p_name").alias("content"), F.col("p_type").alias("notes"))
    new = table(spark, d, "part").where("p_size > 10").select(F.col("p_brand").alias("session"), F.col("p_partkey").alias("new_id"), F.col("p_name").alias("content"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise("x").alias("notes"))
    return m.sync_diff(old, new, "session").groupBy("action").agg(F.count("*").alias("n"))


def _nodes(spark, d):
    """Parts as binary trees of each size."""
    i = F.row_number().over(m.Window.partitionBy("p_size").orderBy("p_partkey"))
    rows = table(spark, d, "part").select(F.col("p_size").cast("long").alias("session_id"), "p_partkey", "p_name", i.cast("long").alias("node_id"))
    return rows.select("session_id", "node_id", F.when(F.col("node_id") > 1, F.floor(F.col("node_id") / 2)).alias("parent_id"), F.col("p_name").alias("content"))


def _tree(spark, d):
    levels = m.tree_levels(_nodes(spark, d))
    kids = _nodes(spark, d).where("parent_id is not null").groupBy("session_id", "parent_id").count().groupBy("session_id").agg(F.max("count").alias("most_children"))
    return levels.groupBy("session_id").agg(F.count("*").alias("nodes"), F.max("depth").alias("depth")).join(kids, "session_id", "left")


def _outline_text(spark, d):
    levels = m.tree_levels(_nodes(spark, d))
    line = F.concat(F.repeat(F.lit("  "), F.col("depth").cast("int")), F.lit("- "), "content")
    return levels.groupBy("session_id").agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node_id", line.alias("line")))), lambda x: x["line"]), "\n")).alias("digest"))


def _answers(spark, d):
    """Assistant turns with the turn before them as context, one row for each sentence."""
    by = m.Window.partitionBy("conv_id").orderBy("turn")
    rows = _turns(spark, d).withColumn("context", F.lag("text").over(by)).where("role = 'assistant'")
    return rows.select((F.col("conv_id") * 2**31 + F.col("turn")).alias("answer_id"), F.coalesce("context", F.lit("")).alias("context"), F.posexplode(F.split(F.regexp_replace("text", r"\.\s+", ".\n"), "\n")).alias("n", "sentence"))


def _bigrams(column):
    w = F.split(F.lower(column), " ")
    return F.when(F.size(w) >= 2, F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - 2, F.lit(0))), lambda i: F.concat(F.get(w, i), F.lit(" "), F.get(w, i + 1)))).otherwise(F.array().cast("array<string>"))


def _claims(spark, d):
    """Every third answer without context; the tables' invented words stand for negations, affirmations and pleasantries."""
    rows = _answers(spark, d).withColumn("context", F.when(F.col("answer_id") % 3 > 0, F.col("context")).otherwise(""))
    return v.grounding(rows, _bigrams("sentence"), share=0.95, negations=["with", "are"], affirmations=["and", "the"], pleasantries=["Th", "A", "In", "On"])


def _checks(spark, d):
    """Three checks of each answer in long form."""
    s = _answers(spark, d)
    g = v.grounding_verdict(v.grounding(s, _bigrams("sentence")), context="context").select("answer_id", F.lit("grounding").alias("check_name"), "passed", F.col("ratio").alias("confidence"))
    h = v.hedging(s, ["the th", "of on"], ["with"]).select("answer_id", F.lit("hedging").alias("check_name"), (F.col("issues") == 0).alias("passed"), "confidence")
    c = v.contradictions(s, _bigrams("sentence"), ["by"]).select("answer_id").distinct().withColumn("bad", F.lit(True))
    w = s.select("answer_id").distinct().join(c, "answer_id", "left").select("answer_id", F.lit("contradiction").alias("check_name"), F.col("bad").isNull().alias("passed"), F.when(F.col("bad"), 0.4).otherwise(1.0).alias("confidence"))
    return g.unionByName(h).unionByName(w)


def _cited(spark, d):
    """An answer cites the short words that end its sentences; its question's words and two more are the sources."""
    by = m.Window.partitionBy("conv_id").orderBy("turn")
    rows = _turns(spark, d).withColumn("question", F.lag("text").over(by)).where("role = 'assistant'")
    cited = t.citations(F.regexp_replace("text", r"(^|[ \n])([a-z]{2,4})\.", "$1[来源：$2.md]"))
    words = F.regexp_extract_all(F.lower(F.coalesce("question", F.lit(""))), F.lit("[a-z]+"), F.lit(0))
    available = F.transform(F.concat(words, F.array(F.lit("the"), F.lit("of"))), lambda w: F.concat(w, F.lit(".md")))
    return v.citation_check(rows.select((F.col("conv_id") * 2**31 + F.col("turn")).alias("answer_id"), cited.alias("cited"), available.alias("available")))


def _vector_grounding(spark, d):
    e = table(spark, d, "embeddings")
    near = nearest(e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), "label"), e, 1, within="label")
    pairs = near.select(F.col("query_id").alias("sentence_id"), F.col("vec_id").alias("chunk_id"))
    pairs = pairs.join(e.select(F.col("vec_id").alias("sentence_id"), F.col("embedding").alias("sv")), "sentence_id").join(e.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("cv")), "chunk_id")
    return v.vector_grounding(pairs)


def _plan_drift(spark, d):
    n = F.col("k")
    steps = calls(spark, d).select("call_id", "tool", F.when(n % 4 == 0, None).when(n % 4 == 1, "view").otherwise(F.col("tool")).alias("planned_tool"), F.when(n % 10 == 0, "then skip this").otherwise("done").alias("output"))
    return logs.plan_drift(steps).groupBy(F.coalesce("drift", F.lit("none")).alias("drift")).agg(F.count("*").alias("n"))


def _streaks(spark, d):
    rows = logs.failure_streaks(calls(spark, d).withColumn("failed", F.col("status") == "error"), 3, ["started_at", "call_id"])
    return rows.groupBy("session_id").agg(F.max("streak").alias("longest"), F.count_if("replan").alias("replans"))


def _complexity(spark, d):
    nth = F.row_number().over(m.Window.partitionBy("conv_id").orderBy("turn")) - 1
    score, mode = logs.complexity(F.col("text"), F.col("earlier"), 10)
    return _turns(spark, d).withColumn("earlier", nth).select("conv_id", "turn", score.alias("score"), mode.alias("mode"))


def _history(spark, d):
    return logs.history_within(_turns(spark, d), 2000).select("conv_id", F.array_join(F.transform("turns", lambda x: x.cast("string")), ",").alias("turns"), "chars")


def _latest_session(spark, d):
    return latest(calls(spark, d).withColumn("slot", F.col("k") % 3), ["session_id", "slot"], [F.col("started_at").desc(), F.col("call_id").desc()]).select("session_id", "slot", "call_id")


def _qa(spark, d):
    """Question and answer pairs of conversations, numbered."""
    by = m.Window.partitionBy("conv_id").orderBy("turn")
    rows = _turns(spark, d).withColumn("question", F.lag("text").over(by)).where("role = 'assistant'")
    return rows.select("conv_id", F.row_number().over(by).cast("long").alias("ordinal"), F.coalesce("question", F.lit("")).alias("question"), F.col("text").alias("answer"))


def _qa_markdown(spark, d):
    part = F.concat(F.lit("### "), F.col("ordinal").cast("string"), F.lit(". "), "question", F.when(F.col("answer") != "", F.concat(F.lit("\n\n"), "answer")).otherwise(""))
    return _qa(spark, d).groupBy("conv_id").agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", part.alias("p")))), lambda x: x["p"]), "\n\n")).alias("digest"))


QUERIES = {
    "m1_arrivals": _arrivals,
    "m2_semantic_duplicates": lambda spark, d: m.semantic_duplicates(table(spark, d, "embeddings").select(F.col("label").alias("project_id"), "vec_id", "embedding"), 0.3),
    "m3_title_duplicates": _title_duplicates,
    "m3_recent_titles": lambda spark, d: latest(_turns(spark, d), ["role"], [F.col("conv_id").desc(), F.col("turn")], 3).select("role", "conv_id", "turn"),
    "m4_retention": _retention,
    "m5_substantive": lambda spark, d: m.substantive(_turns(spark, d), 400),
    "m6_titles": lambda spark, d: m.conversation_titles(_turns(spark, d)),
    "m7_failure_rules": lambda spark, d: latest(calls(spark, d).groupBy("tool", "k").agg(F.min("call_id").alias("call_id")), ["tool"], [F.col("call_id").desc()], 20).select("tool", "k", "call_id"),
    "m8_items": _items,
    "m9_fuzzy_duplicates": _fuzzy,
    "m10_standardise": _standardise,
    "m10_missing": lambda spark, d: m.treat_missing(_gaps(spark, d), _MISSING).select("o_orderkey", "price", "price_missing", "clerk", "state"),
    "m10_step_counts": lambda spark, d: m.missing_counts(_gaps(spark, d), _MISSING),
    "m11_drift": _drift,
    "m12_stale": _stale,
    "m13_candidates": _candidates,
    "m15_upsert": _upsert,
    "m18_transition": _transition,
    "m19_queue": _queue,
    "m20_cascade": _cascade,
    "m21_versions": _versions,
    "m22_sync": _sync,
    "m23_auto_approval": _approve,
    "a29_outline_statistics": _tree,
    "s10_outline_text": _outline_text,
    "s5_recent_events": lambda spark, d: latest(table(spark, d, "events"), ["event_type"], [F.col("ts").desc(), F.col("event_id").desc()], 5).select("event_type", "event_id"),
    "s7_qa_markdown": _qa_markdown,
    "j1_hit_resolution": lambda spark, d: chunks(spark, d).join(_docs(spark, d).select(F.col("doc_id").alias("document_id"), "lang"), "document_id").groupBy("lang").agg(F.count("*").alias("chunks")),
    "j2_attachment_exclusion": _attachments,
    "j3_project_scope": _scope,
    "j4_parent_expansion": _parents,
    "j7_link_suggestions": _suggest,
    "j7_own_suggestions": _suggest_own,
    "j8_work_list": _work_list,
    "j9_cache_validity": _cache,
    "j11_meeting_assets": _meetings,
    "j12_session_snapshot": _session_snapshot,
    "j13_coverage": _coverage,
    "j14_cells": _sign_off,
    "k4_constant_scores": _constant_scores,
    "j15_scope_items": _scope_items,
    "j17_listing": lambda spark, d: k.page_of(_docs(spark, d), [F.col("doc_id").desc()], 10, 50).select("doc_id", "source"),
    "j19_identity": _identity,
    "j20_awaiting": _awaiting,
    "l1_repeated_calls": lambda spark, d: logs.repeated_calls(calls(spark, d).withColumn("step", F.lit(0)), 1).select("call_id", "nth"),
    "l2_disallowed": lambda spark, d: logs.disallowed_calls(calls(spark, d).withColumn("step", F.col("k") % 3), calls(spark, d).select((F.col("k") % 3).alias("step"), "tool").distinct().where("step <> 1 or tool = 'view'")).groupBy("tool").agg(F.count("*").alias("n")),
    "l3_plan_drift": _plan_drift,
    "l4_latest_session": _latest_session,
    "l5_streaks": _streaks,
    "l5_step_results": _step_results,
    "l6_rate_audit": lambda spark, d: logs.rate_audit(calls(spark, d), 1, 3600).select("call_id", "recent", "over"),
    "l6_rate_limit": lambda spark, d: logs.rate_limit(calls(spark, d), 1, 3600),
    "l7_complexity": _complexity,
    "l8_intent": lambda spark, d: _turns(spark, d).select("conv_id", "turn", logs.intent_flag(F.col("text"), ["the", "With", "zzz"]).alias("intent")),
    "l9_history": _history,
    "v1_citations": _cited,
    "v2_grounding": lambda spark, d: v.grounding(_answers(spark, d), _bigrams("sentence")).select("answer_id", F.col("n").cast("long").alias("n"), "supported"),
    "v3_vector_grounding": _vector_grounding,
    "v4_verdict": lambda spark, d: v.grounding_verdict(v.grounding(_answers(spark, d), _bigrams("sentence")), context="context"),
    "v4_claims": lambda spark, d: v.grounding_verdict(_claims(spark, d), context="context"),
    "v5_contradictions": lambda spark, d: v.contradictions(_answers(spark, d), _bigrams("sentence"), ["by"]).select("answer_id", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j")),
    "v6_hedging": lambda spark, d: v.hedging(_answers(spark, d), ["the th", "of on"], ["with"]),
    "v7_report": lambda spark, d: v.report(_checks(spark, d)),
    "w1_neighbour_chunks": lambda spark, d: v.neighbours_in_document(chunks(spark, d)).select("chunk_id", F.md5(F.coalesce("previous", F.lit(""))).alias("previous"), F.md5(F.coalesce("next", F.lit(""))).alias("next")),
}

_TREE = """n0 as (select cast(p_size as bigint) as session_id, p_name as content, row_number() over (partition by p_size order by p_partkey) as node_id from part),
    lv as (select *, cast(floor(log2(node_id)) as bigint) as depth from n0)"""
_ANS = r"""ctx as (select *, lag(text) over (partition by conv_id order by turn) as context from conversations),
    ans as (select answer_id, context, sentence, i - 1 as n from (select conv_id * 2147483648 + turn as answer_id, coalesce(context, '') as context, unnest(string_split(regexp_replace(text, '\.[ \t\r\n\f]+', '.' || chr(10), 'g'), chr(10))) as sentence,
        unnest(range(1, len(string_split(regexp_replace(text, '\.[ \t\r\n\f]+', '.' || chr(10), 'g'), chr(10))) + 1)) as i from ctx where role = 'assistant')),
    bi as (select *, [w[j] || ' ' || w[j + 1] for j in range(1, len(w))] as g from (select *, string_split(lower(sentence), ' ') as w from ans)),
    sup as (select answer_id, n, len(g) = 0 or len([x for x in g if not contains(context, x)]) <= floor(len(g) * 0.6::double) as supported from bi),
    gv as (select answer_id, round(avg(supported::int), 6) as ratio, round(avg(supported::int), 6) >= 0.8 as passed from sup group by 1),
    ng as (select answer_id, n, contains(' ' || lower(sentence) || ' ', ' by ') as neg, unnest(list_distinct(g)) as gram from bi),
    con as (select distinct a.answer_id, least(a.n, b.n) as i, greatest(a.n, b.n) as j from ng a join ng b on a.answer_id = b.answer_id and a.gram = b.gram and not a.neg and b.neg),
    hg as (select answer_id, count(*) filter (where contains(sentence, 'with') or ((contains(sentence, 'the th') or contains(sentence, 'of on')) and not contains(sentence, 'with'))) as issues, count(*) as total from ans group by 1)"""
_DELIVERABLES = r"""req as (select phase, name, k % 2 = 1 as required from (select distinct p_brand as phase from part), (select unnest(['ring.doc', 'widget', 'gear', 'large bolt.v2', 'none']) as name, unnest([1, 2, 3, 4, 5]) as k)),
    fl as (select distinct p_brand as phase, path, regexp_replace(path[5:], '\.[^.]*$', '') as stem from (select *, 'out/' || case when p_size % 4 = 0 then string_split(p_name, ' ')[-1] else p_name end || case p_size % 3 when 0 then '' when 1 then '.doc' else '.v2' end as path from part where p_size < 20))"""
_CAND = """cand as (select 'part-' || p_partkey as slug, case when p_partkey % 3 = 0 or p_partkey % 5 = 0 then 'pending' when levenshtein(lower(x), lower(p_name)) / greatest(length(x), length(p_name)) <= 0.3 then 'auto' else 'conflict' end as status
    from (select *, case when p_partkey % 2 = 0 then p_name || 's' else p_type end as x from part))"""

ORACLES = {
    "m22_sync": """with o as (select p_brand as s, p_partkey as i, p_name as c, p_type as n from part), w as (select p_brand as s, p_partkey as i, p_name as c, case when p_size % 2 = 0 then p_type else 'x' end as n from part where p_size > 10),
        a1 as (select *, row_number() over (partition by s, c, n order by i) as r from o), b1 as (select *, row_number() over (partition by s, c, n order by i) as r from w), e as (select a1.i as x, b1.i as y from a1 join b1 using (s, c, n, r)),
        a2 as (select *, row_number() over (partition by s, c order by i) as r from o where i not in (select x from e)), b2 as (select *, row_number() over (partition by s, c order by i) as r from w where i not in (select y from e)), l as (select a2.i as x, b2.i as y from a2 join b2 using (s, c, r))
        select action, count(*) as n from (select 'keep' as action from e union all select 'update' from l union all select 'delete' from a2 where i not in (select x from l) union all select 'insert' from b2 where i not in (select y from l)) group by 1""",
    "m1_arrivals": """with k as (select sha256(text) as s, doc_id % 5 as p, doc_id from documents), e as (select s, p, max(doc_id % 3) as c from k where doc_id % 4 = 0 group by 1, 2),
        r as (select k.*, c, row_number() over (partition by k.s, k.p order by doc_id) as nth from k left join e on k.s = e.s and k.p = e.p)
        select doc_id, case when c > 0 then 'duplicate' when nth > 1 then 'repeat' when c = 0 then 'orphan' else 'new' end as state from r""",
    "m2_semantic_duplicates": "select * from (select a.label as project_id, a.vec_id as keep, b.vec_id as drop, round(list_cosine_similarity(cast(a.embedding as double[]), cast(b.embedding as double[])), 6) as similarity from embeddings a join embeddings b on a.label = b.label and a.vec_id < b.vec_id) where similarity > 0.3",
    "m3_recent_titles": "select role, conv_id, turn from (select *, row_number() over (partition by role order by conv_id desc, turn) as r from conversations) where r <= 3",
    "m4_retention": "select doc_id, source from (select *, row_number() over (partition by source order by doc_id desc) as r from documents) where r <= 20",
    "m5_substantive": "select conv_id, cast(sum(case when role = 'user' then length(trim(text)) else 0 end) as bigint) as user_chars from conversations group by 1 having sum(case when role = 'user' then length(trim(text)) else 0 end) >= 400",
    "m6_titles": r"select conv_id, coalesce(min_by(x, turn) filter (where role = 'user' and x <> ''), 'New conversation') as title from (select *, trim(regexp_replace(text, '[\x00-\x1f\x7f]', '', 'g')[1:40]) as x from conversations) group by 1",
    "m7_failure_rules": f"with {CALLS}, g as (select tool, k, min(call_id) as call_id from calls group by 1, 2) select tool, k, call_id from (select *, row_number() over (partition by tool order by call_id desc) as r from g) where r <= 20",
    "m8_items": "select item_id, category, description, flag, confidence from (select p_partkey as item_id, case when p_size > 5 then p_brand else 'general' end as category, trim(p_name) as description, p_size % 2 = 0 as flag, round(greatest(least(p_retailprice / 1000, 1), 0), 6) as confidence, row_number() over (partition by lower(case when p_size > 5 then p_brand else 'general' end), lower(trim(p_name)), p_size % 2 = 0 order by p_partkey) as r from part) where r = 1",
    "m9_fuzzy_duplicates": "with k as (select p_brand, p_name, min(p_partkey) as p from part group by 1, 2) select a.p as a, b.p as b from k a join k b on a.p_brand = b.p_brand and a.p < b.p where levenshtein(a.p_name, b.p_name) <= greatest(length(a.p_name), length(b.p_name)) * 0.3::double",
    "m10_standardise": "select o_orderkey, cast(o_orderdate as date) as day, cast(round(o_totalprice) as bigint) as price, lower(regexp_extract(o_orderpriority, '-(.*)$', 1)) as priority from orders",
    "m11_drift": f"select doc_id from documents where doc_id % 13 <> 0 and regexp_matches(text, '{_MAIL}')",
    "m12_stale": f"select case event_type when 'error' then 'remove' when 'view' then 'reindex' else 'update' end as action, count(*) as n, max(date_diff('day', cast(ts as date), date '{_DATE}')) as oldest from events where date_diff('day', cast(ts as date), date '{_DATE}') > 20 group by 1",
    "m13_candidates": f"with {_CAND} select * from cand",
    "m15_upsert": "with c as (select doc_id, 1 as version, 'old' as state, 0 as n from documents union all select doc_id * 2, cast(doc_id % 2 * 2 as int), 'new', 1 from documents where doc_id % 3 = 0) select doc_id, state from (select *, row_number() over (partition by doc_id order by version desc, n desc) as r from c) where r = 1",
    "m18_transition": f"""with ph as (select cast(n_regionkey as bigint) as project_id, row_number() over (partition by n_regionkey order by n_nationkey) - 1 as p,
            case when n_nationkey % 3 <> 0 then date '2023-01-01' + cast(n_nationkey as int) end as s, case when n_nationkey % 4 = 0 then date '2023-06-01' + cast(n_nationkey as int) end as e from nation),
            t as (select cast(n_regionkey as bigint) as project_id, count(*) % 5 as target from customer join nation on c_nationkey = n_nationkey group by 1)
        select project_id, p as phase_index, case when p < target then 'completed' when p = target then 'current' else 'pending' end as status,
            case when p <= target then coalesce(s, date '{_DATE}') end as started, case when p < target then coalesce(e, date '{_DATE}') end as ended from ph join t using (project_id)""",
    "m19_queue": """with l as (select user_id % 20 as project_id, cast(json_extract_string(props, '$.k') as bigint) as item, case event_type when 'error' then 'failed' when 'click' then 'done' else 'pending' end as state, ts, event_id from events),
        s as (select project_id, item, max_by(state, struct_pack(ts := ts, e := event_id)) as st, count(*) filter (where state = 'failed') as f, min(ts) as first from l group by 1, 2), u as (select project_id, item, case when st = 'failed' and f < 3 then 'pending' else st end as state, first from s)
        select project_id, item, state, case when state = 'pending' then row_number() over (partition by project_id, state order by first, item) end as position from u""",
    "m20_cascade": f"with {CHUNKS} select document_id, count(*) as chunks from chunks where document_id % 11 <> 0 group by 1",
    "m21_versions": "select o_custkey, o_orderkey, coalesce((select count(*) from orders e where e.o_custkey = o.o_custkey and e.o_orderkey % 2 = 0), 0) + row_number() over (partition by o_custkey order by o_orderkey) as version from orders o where o_orderkey % 2 = 1",
    "m23_auto_approval": f"with {_CAND} select case when status = 'auto' then 'approved' else 'skipped' end as action, count(*) as n from cand group by 1",
    "a29_outline_statistics": f"with {_TREE}, k as (select session_id, max(c) as most from (select session_id, node_id // 2 as p, count(*) as c from n0 where node_id > 1 group by 1, 2) group by 1) select l.session_id, count(*) as nodes, max(depth) as depth, any_value(most) as most_children from lv l left join k using (session_id) group by 1",
    "s10_outline_text": f"with {_TREE} select session_id, md5(string_agg(repeat('  ', depth) || '- ' || content, chr(10) order by node_id)) as digest from lv group by 1",
    "s5_recent_events": "select event_type, event_id from (select *, row_number() over (partition by event_type order by ts desc, event_id desc) as r from events) where r <= 5",
    "s7_qa_markdown": "with c as (select *, lag(text) over (partition by conv_id order by turn) as q from conversations), a as (select conv_id, row_number() over (partition by conv_id order by turn) as o, coalesce(q, '') as q, text from c where role = 'assistant') select conv_id, md5(string_agg('### ' || o || '. ' || q || case when text <> '' then chr(10) || chr(10) || text else '' end, chr(10) || chr(10) order by o)) as digest from a group by 1",
    "j1_hit_resolution": f"with {CHUNKS} select lang, count(*) as chunks from chunks join documents on doc_id = document_id group by 1",
    "j2_attachment_exclusion": f"with {CHUNKS} select project_id, count(*) as chunks from chunks where document_id % 25 <> 0 group by 1",
    "j3_project_scope": "select own, count(*) as documents from (select 'src' || i as own, unnest(['src' || i, 'src' || ((i + 1) % 20)]) as source from range(20) r(i)) join documents using (source) group by 1",
    "j4_parent_expansion": f"with {CHUNKS}, h as (select distinct case when line_no % 3 = 2 then chunk_id - 1 else chunk_id end as chunk_id from chunks where contains(content, 'tion')) select chunk_id, document_id from chunks where chunk_id in (select chunk_id from h)",
    "j7_link_suggestions": "with w as (select distinct string_split(p_name, ' ')[-1] as query from part) select query, slug from (select query, 'part-' || p_partkey as slug, row_number() over (partition by query order by p_name, 'part-' || p_partkey) as r from part join w on contains(p_name, query)) where r <= 5",
    "j7_own_suggestions": """with p as (select 'part-' || p_partkey as slug, p_name as title, p_partkey from part), q as (select case when p_partkey % 100 = 0 then slug else title end as query, slug as self_slug from p where p_partkey % 50 = 0)
        select query, self_slug, slug from (select query, self_slug, slug, row_number() over (partition by query, self_slug order by title, slug) as r from p join q on (contains(title, query) or contains(slug, query)) and slug <> self_slug) where r <= 5""",
    "j8_work_list": "select doc_id as identity from documents where doc_id % 2 <> 0",
    "j9_cache_validity": "select doc_id, coalesce(text[1] = 'T' and regexp_matches(text, '[a-z]+[,;]'), false) as hit from documents",
    "j11_meeting_assets": "select o_orderkey as meeting_id, c_name, n_name, coalesce(l.n, 0) as lines from orders left join customer on o_custkey = c_custkey left join nation on c_nationkey = n_nationkey left join (select l_orderkey, count(*) as n from lineitem group by 1) l on l_orderkey = o_orderkey",
    "j12_session_snapshot": f"with {CALLS} select session_id, md5(string_agg(cast(call_id as varchar), ',' order by started_at, call_id)) as digest from calls group by 1",
    "j13_coverage": f"""with {_DELIVERABLES}, hit as (select q.phase, q.name, min(path) as path from req q join fl f on f.phase = q.phase and (contains(path, q.name) or contains(q.name, stem) or contains(stem, q.name)) group by 1, 2)
        select q.phase, q.name, q.required, case when path is not null then 'pending' when q.required then 'missing' else 'optional' end as status, path from req q left join hit using (phase, name)
        union all select phase, path[5:], false, 'optional', path from fl where (phase, path[5:]) not in (select (phase, name) from req)""",
    "j14_cells": f"""with {_DELIVERABLES}, c as (select phase || '/' || name as cell, phase, name, regexp_replace(name, '\\.[^.]*$', '') as ns from req),
        e as (select o_orderkey as event, 'Brand#' || o_custkey % 30 as ep, ['ring', 'widget.doc', 'bolt', 'large bolt', 'zzz'][o_orderkey % 5 + 1] as en, regexp_replace(['ring', 'widget.doc', 'bolt', 'large bolt', 'zzz'][o_orderkey % 5 + 1], '\\.[^.]*$', '') as es, o_orderstatus = 'F' as so from orders where o_orderstatus <> 'P'),
        ch as (select event, so, min(cell) as cell from e join c on (contains(phase, ep) or contains(ep, phase)) and (ns = es or contains(name, en) or contains(en, ns)) group by 1, 2),
        l as (select cell, max_by(so, event) as so, bool_or(so) as ever from ch group by 1)
        select cell, phase, name, case when ever then 'done' else 'pending' end as status, coalesce(so, false) as signed_off from c left join l using (cell)""",
    "k4_constant_scores": "select p_brand, p_name, 1.0::double as score from part where contains(lower(p_name), 'ring') union select p_brand, p_name, 0.5::double from part where contains(lower(p_type), 'small') union select p_brand, p_name, 1.0::double from part where contains(lower(p_name), 'small')",
    "l5_step_results": f"""with c as (select *, lag(text) over (partition by conv_id order by turn) as expected, case text[1] when 'T' then text[1:8] when 'I' then '  ' when 'E' then text || ' Timeout' else text end as output from conversations),
        r as (select conv_id, turn, case when trim(output, ' ' || chr(9) || chr(10) || chr(13)) = '' then 'empty' when len([w for w in {logs.STEP_FAILURES} if contains(lower(output), w)]) > 0 then 'word:' || [w for w in {logs.STEP_FAILURES} if contains(lower(output), w)][1] when strlen(output) < 10 and strlen(expected) > 50 then 'short' end as reason from c),
        i as (select *, sum((reason is null)::int) over (partition by conv_id order by turn rows unbounded preceding) as island from r)
        select conv_id, turn, reason, cast(sum((reason is not null)::int) over (partition by conv_id, island order by turn rows unbounded preceding) as bigint) as streak, sum((reason is not null)::int) over (partition by conv_id, island order by turn rows unbounded preceding) >= 2 as replan from i""",
    "m3_title_duplicates": r"""with t as (select conv_id, conv_id % 5 as p, coalesce(min_by(x, turn) filter (where role = 'user' and x <> ''), 'New conversation') as title from (select *, trim(regexp_replace(text, '[\x00-\x1f\x7f]', '', 'g')[1:2]) as x from conversations) group by 1),
        l as (select p, title from (select *, row_number() over (partition by p order by conv_id % 7, conv_id) as r from t where conv_id % 2 = 0) where r <= 3)
        select conv_id, title, (p, title) in (select (p, title) from l) as duplicate from t where conv_id % 2 = 1""",
    "m10_missing": "select o_orderkey, case when o_orderkey % 6 > 0 then cast(round(o_totalprice) as bigint) else 0 end as price, o_orderkey % 6 = 0 as price_missing, o_custkey as clerk, case when o_orderstatus <> 'P' then o_orderstatus else '?' end as state from orders where o_orderkey % 5 > 0",
    "m10_step_counts": """select 1 as step, 'price' as column, 'mark' as action, count(*) as rows, count(*) filter (where o_orderkey % 6 = 0) as missing from orders union all select 2, 'price', 'fill', count(*), count(*) filter (where o_orderkey % 6 = 0) from orders
        union all select 3, 'clerk', 'drop', count(*), count(*) filter (where o_orderkey % 5 = 0) from orders union all select 4, 'state', 'fill', count(*) filter (where o_orderkey % 5 > 0), count(*) filter (where o_orderkey % 5 > 0 and o_orderstatus = 'P') from orders""",
    "l6_rate_limit": f"""with recursive {CALLS}, n as (select session_id, call_id, started_at, row_number() over (partition by session_id order by started_at, call_id) as r from calls),
        d as (select session_id, call_id, r, started_at as held, true as accepted from n where r = 1
            union all select n.session_id, n.call_id, n.r, case when n.started_at - held >= interval 3600 second then n.started_at else held end, n.started_at - held >= interval 3600 second from d join n on n.session_id = d.session_id and n.r = d.r + 1)
        select session_id, call_id, accepted from d""",
    "j15_scope_items": "select p_brand, p_partkey, p_name from (select *, row_number() over (partition by p_brand order by p_partkey) as r from part where contains(lower(p_name), 'ring') or contains(lower(p_brand), 'ring')) where r <= 3",
    "j17_listing": "select doc_id, source from documents order by doc_id desc limit 50 offset 10",
    "j19_identity": r"select page_id, case when page_id % 5 = 0 then 'id-' || page_id else coalesce(nullif(regexp_extract(url, '([^/\\]+)$', 1), ''), 'untitled') end as identity from pages",
    "j20_awaiting": "select o_orderkey from orders where o_orderstatus = 'F' and o_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'R')",
    "l1_repeated_calls": f"with {CALLS} select call_id, nth from (select call_id, row_number() over (partition by session_id, tool, args[1:100] order by started_at, call_id) as nth from calls) where nth > 1",
    "l2_disallowed": f"with {CALLS} select tool, count(*) as n from calls where k % 3 = 1 and tool <> 'view' group by 1",
    "l3_plan_drift": f"with {CALLS} select case when k % 10 = 0 then 'phrase:skip' when k % 4 = 1 and tool <> 'view' then 'tool' when k % 4 = 0 then 'no_tool' else 'none' end as drift, count(*) as n from calls group by 1",
    "l4_latest_session": f"with {CALLS} select session_id, slot, call_id from (select session_id, k % 3 as slot, call_id, row_number() over (partition by session_id, k % 3 order by started_at desc, call_id desc) as r from calls) where r = 1",
    "l5_streaks": f"with {CALLS}, i as (select *, sum((status <> 'error')::int) over (partition by session_id order by started_at, call_id rows unbounded preceding) as island from calls), s as (select session_id, sum((status = 'error')::int) over (partition by session_id, island order by started_at, call_id rows unbounded preceding) as streak from i) select session_id, cast(max(streak) as bigint) as longest, count(*) filter (where streak >= 3) as replans from s group by 1",
    "l6_rate_audit": f"with {CALLS} select call_id, recent, recent > 1 as over from (select call_id, count(*) over (partition by session_id order by started_at range between interval 3600 second preceding and current row) as recent from calls)",
    "l7_complexity": "with c as (select *, row_number() over (partition by conv_id order by turn) - 1 as e from conversations), s as (select conv_id, turn, cast(greatest(3 * len([w for w in {en} if contains(lower(text), w)]) + least(floor(strlen(text) / 200), 5) + 2 * least(floor(floor(e / 2) / 4), 3) - 5 * len([w for w in {si} if contains(lower(text), w)]), 0) as bigint) as score from c) select conv_id, turn, score, case when score >= 10 then 'planned' else 'direct' end as mode from s".replace("{en}", str(logs.COMPLEX_EN)).replace("{si}", str(logs.SIMPLE)),
    "l8_intent": "select conv_id, turn, contains(lower(text), 'the') and contains(lower(text), 'with') as intent from conversations",
    "l9_history": "select conv_id, string_agg(cast(turn as varchar), ',' order by turn) as turns, cast(max(used) as bigint) as chars from (select *, sum(length(text)) over (partition by conv_id order by turn desc rows unbounded preceding) as used from conversations) where used <= 2000 group by 1",
    "v1_citations": r"""with c as (select *, lag(text) over (partition by conv_id order by turn) as q from conversations), x as (select conv_id * 2147483648 + turn as answer_id, [w || '.md' for w in regexp_extract_all(text, '(?:^|[ \n])([a-z]{2,4})\.', 1)] as cited,
            list_concat([w || '.md' for w in regexp_extract_all(lower(coalesce(q, '')), '[a-z]+')], ['the.md', 'of.md']) as av from c where role = 'assistant'),
        y as (select answer_id, len(cited) as n, len([k for k in cited if len([a for a in av if contains(a, k)]) > 0]) as found from x)
        select answer_id, n = 0 or found = n as passed, case when n = 0 then 0.7::double else round(found / n, 6) end as confidence from y""",
    "v2_grounding": f"with {_ANS} select * from sup",
    "v3_vector_grounding": """with p as (select s.vec_id as sentence_id, c.vec_id as chunk_id, round(list_cosine_similarity(cast(s.embedding as double[]), cast(c.embedding as double[])), 6) as similarity from embeddings s join embeddings c on s.label = c.label and s.vec_id <> c.vec_id where s.vec_id % 50 = 0)
        select sentence_id, chunk_id, similarity, case when similarity >= 0.7 then 'supported' when similarity >= 0.4 then 'weak' else 'unsupported' end as verdict from (select *, row_number() over (partition by sentence_id order by similarity desc, chunk_id) as r from p) where r = 1""",
    "v4_verdict": f"with {_ANS} select * from gv",
    "v4_claims": f"""with {_ANS}, cl as (select *, case when answer_id % 3 > 0 then context else '' end as c from bi),
        mm as (select *, case when contains(c, 'and') or contains(c, 'the') then cast(contains(sentence, 'with') and not contains(c, 'with') as int) + cast(contains(sentence, 'are') and not contains(c, 'are') as int) else 0 end as bad from cl),
        ok as (select answer_id, c, case when not regexp_matches(sentence, '^(Th|A|In|On)') then case when len(g) = 0 then bad = 0 else len([x for x in g if not contains(c, x)]) + bad <= floor(len(g) * 0.95::double) end end as supported from mm),
        v as (select answer_id, max(c) = '' as blank, coalesce(round(avg(supported::int), 6), 1.0) as ratio from ok group by 1)
        select answer_id, case when blank then 0.5 else ratio end as ratio, blank or ratio >= 0.8 as passed from v""",
    "v5_contradictions": f"with {_ANS} select * from con",
    "v6_hedging": f"with {_ANS} select answer_id, issues, round(1 - issues / total, 6) as confidence from hg",
    "v7_report": f"""with {_ANS}, ck as (select answer_id, 'grounding' as c, passed, ratio as conf from gv union all select answer_id, 'hedging', issues = 0, round(1 - issues / total, 6) from hg
            union all select a.answer_id, 'contradiction', c.answer_id is null, case when c.answer_id is null then 1.0 else 0.4 end from (select distinct answer_id from ans) a left join (select distinct answer_id from con) c using (answer_id)),
        g as (select answer_id, count(*) as total, count(*) filter (where passed) as ok, avg(conf) as m, min(conf) as low, bool_or(c = 'grounding' and not passed) as b1, bool_or(c = 'contradiction' and not passed) as b2 from ck group by 1)
        select answer_id, case when ok = total and m >= 0.8 then 'confirmed' when ok = total then 'needs_review' when ok = 0 then 'failed' when ok >= total // 2 then 'needs_review' else 'suspected' end as level, round(m, 6) as confidence,
            concat_ws(',', case when b1 then 'not_grounded' end, case when b2 then 'contradiction' end, case when low < 0.5 then 'low_confidence' end) as labels from g""",
    "w1_neighbour_chunks": f"with {CHUNKS} select chunk_id, md5(coalesce(lag(content) over w, '')) as previous, md5(coalesce(lead(content) over w, '')) as next from chunks window w as (partition by document_id order by line_no)",
}
