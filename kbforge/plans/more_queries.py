"""Transcripts, page candidates, meetings, registers, and hybrid search end to end."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import transcript
from ..operators import analytics as a
from ..operators import logs
from ..operators import lookups as lk
from ..operators import maintenance as m
from ..operators import retrieval as r
from ..operators import vectortable as vt
from ..sources.scratch import fresh_dir, stored
from ..streaming import streams as st
from .fixtures import chunks, table
from .search_queries import _BM25, _FUSED, _asked_vectors, _chunk_vectors, _fused, _posted, _titled, _tokens
from .stream_queries import _stream


def _transcripts(spark, d):
    text = transcript.clean_transcript(F.concat(F.lit("然后然后我们 看看 "), "text"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(text).alias("digest"))


def _repeats(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", transcript.collapse_repeats(F.concat(F.lit("okok "), F.left("role", F.lit(3)), F.lit(" nooo"))).alias("text"))


#: Utterances as recognised, and as they read after clean-up.
SPOKEN = [
    ("我们先看看但是没有时间", "我们先看看，但是没有时间。"),
    ("然后然后我好好好想那个那个那个", "然后我好好想那个。"),
    ("这个方案什么时候能上线", "这个方案什么时候能上线？"),
    ("嗯。今天先讨论预算和人员的安排。好的。", "嗯。今天先讨论预算和人员的安排，好的。"),
    ("项目 进度 正常所以 不用担心！", "项目进度正常，所以不用担心！"),
]


def _spoken(spark, d):
    """A turn says one of the utterances, by the length of its text."""
    said = F.array(*[F.lit(x) for x, _ in SPOKEN])
    nth = F.length("text") % len(SPOKEN) + 1
    return table(spark, d, "conversations").select("conv_id", "turn", transcript.clean_transcript(F.element_at(said, nth)).alias("text"))


def _rules(spark, d):
    """Failed and blocked events as failures, their payload and a word as the reason."""
    kind = F.when(F.col("event_type") == "error", "exhausted").when(F.col("event_type") == "view", "replan").when(F.col("event_type") == "click", "timeout").otherwise("other")
    word = F.element_at(F.array(*[F.lit(x) for x in ("result empty ", "超时 ", "not supported ", "")]), (F.get_json_object("props", "$.k").cast("int") % 4 + 1))
    return table(spark, d, "events").select("event_id", logs.rule_of(kind, F.concat(word, "props")).alias("rule"))


def _cache_keys(spark, d):
    """Which sources (orders) wrote a page (part)."""
    written = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("source")).agg(F.collect_set(F.concat(F.lit("part-"), "l_partkey")).alias("files"))
    pages = table(spark, d, "part").select(F.concat(F.lit("part-"), "p_partkey").alias("slug"))
    return lk.keys_of_pages(written, pages)


def _sign_off(spark, d):
    """The last event of a project decides whether its pending cells are done."""
    ev = table(spark, d, "events").where("event_type in ('purchase', 'error')").groupBy((F.col("user_id") % 20).alias("project_id")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last"))
    cells = table(spark, d, "orders").select((F.col("o_custkey") % 20).alias("project_id"), "o_orderkey", F.when(F.col("o_orderstatus") == "P", "pending").otherwise("done").alias("status"))
    out = cells.join(ev, "project_id", "left").withColumn("status", F.when((F.col("status") == "pending") & (F.col("last") == "purchase"), "done").otherwise(F.col("status")))
    return out.groupBy("project_id", "status").agg(F.count("*").alias("n"))


def _register(spark, d):
    """Rows with their id under one of two headers, closed and blank ones dropped."""
    raw = table(spark, d, "orders").select(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey").cast("string")).alias("编号"), F.when(F.col("o_orderkey") % 2 == 1, F.concat(F.lit("R-"), "o_orderkey")).alias("id"), F.col("o_orderstatus").alias("state"))
    return lk.normalise_register(raw, ["id", "编号"], F.col("state").rlike("^F")).select("id", "state")


def _meetings(spark, d):
    rows = table(spark, d, "orders").where(F.contains("o_orderpriority", F.lit("HIGH")) & (F.col("o_orderstatus") == "O"))
    return a.latest(rows, ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey")], 2).select("o_custkey", "o_orderkey")


def _approve(spark, d):
    """Approved candidates become the content and raise the version, rejected ones are cleared; links come from the new content."""
    p = table(spark, d, "part").select(F.concat(F.lit("part-"), "p_partkey").alias("slug"), F.concat(F.lit("old [[part-"), (F.col("p_partkey") + 1).cast("string"), F.lit("]]")).alias("content"), F.concat(F.lit("new [[part-"), (F.col("p_partkey") + 2).cast("string"), F.lit("|x]]")).alias("candidate"), (F.col("p_size") % 2 == 0).alias("approve"))
    return lk.review(p.withColumn("version", F.lit(1))).select("slug", "version", F.array_join("wikilinks", ",").alias("links"))


def _merge_meetings(spark, d):
    """Known and fetched meetings: a known project stays, ignored stays ignored, one with a project is linked."""
    o = table(spark, d, "orders")
    known = o.where("o_orderkey % 3 <> 0").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey")).alias("project"), F.when(F.col("o_orderkey") % 7 == 0, "ignored").otherwise("unlinked").alias("status"))
    fetched = o.where("o_orderkey % 5 <> 0").select("o_orderkey", F.when(F.col("o_orderkey") % 4 == 1, F.col("o_custkey") + 1).alias("project"))
    return lk.merge_meetings(known, fetched, "o_orderkey")


def _payloads(spark, d):
    """Meeting lists under different keys of a JSON payload, exploded, with their status mapped."""
    inner = F.concat(F.lit('[{"id": '), "event_id", F.lit(', "status": "'), "event_type", F.lit('"}]'))
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"meetings": '), inner, F.lit("}"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit('{"data": {"list": '), inner, F.lit("}}"))).otherwise(inner)
    each = lk.payload_rows(raw, ["$.meetings", "$.meeting_info_list", "$.data.list"], "struct<id:bigint,status:string>")
    rows = table(spark, d, "events").select(F.explode(each).alias("m"))
    return rows.select(F.col("m.id").alias("id"), F.when(F.col("m.status") == "view", "ended").when(F.col("m.status") == "click", "ongoing").otherwise("scheduled").alias("status"))


def _deliverables(spark, d):
    rows = table(spark, d, "part").select(F.col("p_brand").alias("phase"), F.element_at(F.array(F.lit("done"), F.lit("pending"), F.lit("missing"), F.lit("optional")), (F.col("p_size") % 4 + 1).cast("int")).alias("status"))
    return lk.state_counts(rows, "phase", "status", ["done", "pending", "missing", "optional"])


def _compaction(spark, d):
    """A third of the vectors of four folders and a tenth of the others are deleted, then folders with over a fifth dead are rewritten."""
    path = fresh_dir(spark, "vectors")
    v = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    vt.append(path, v, 1, 8)
    turn = F.floor(F.col("vec_id") / 8)
    vt.delete(path, v.where(((F.col("vec_id") % 8 < 4) & (turn % 3 == 0)) | (turn % 10 == 0)).select("vec_id"), 2)
    before = stored(vt.read_live(spark, path), "before")
    found = vt.compact(spark, path)
    after = spark.read.parquet(f"{path}/rows").groupBy("folder").agg(F.count("*").alias("stored_after"))
    live = lambda rows, name: rows.groupBy(F.pmod("vec_id", F.lit(8)).cast("int").alias("folder")).agg(F.count("*").alias(name), F.round(F.sum(F.element_at("embedding", 1)), 4).alias(f"{name}_sum"))
    return found.join(after, "folder").join(live(before, "live_before"), "folder").join(live(vt.read_live(spark, path), "live_after"), "folder").drop("dead")


def _vector_table(spark, d):
    """Whole vectors after a keyed replacement (turned round) and a removal."""
    v = table(spark, d, "embeddings").select("vec_id", F.lit(1).alias("version"), "label", F.col("embedding").cast("array<double>").alias("embedding"))
    new = v.where("vec_id % 4 = 0").select("vec_id", F.lit(2).alias("version"), F.lit(-1).cast(v.schema["label"].dataType).alias("label"), F.reverse("embedding").alias("embedding"))
    found = m.replace_vectors(v, new, v.where("vec_id % 10 = 3"))
    at = lambda k: F.round(F.element_at("embedding", k), 6)
    return found.select("vec_id", "label", F.size("embedding").cast("long").alias("dims"), at(1).alias("first"), at(2).alias("second"), at(-1).alias("last"))


def _hybrid(spark, d):
    """Passages against chunks by vectors and by BM25, fused, cut to 2k and diversified."""
    cut = r.top(_fused(spark, d), 10, ["query_id"], [F.col("score").desc(), F.col("chunk_id")]).drop("rank")
    return r.diversify(_titled(spark, d, cut), 5).select("query_id", "chunk_id", "title", "source", F.col("rank").cast("long").alias("rank"))


def _end_to_end(spark, d):
    """Passages, every eighth a word that pages answer, against chunks; a document's vector stands for its first chunk, every 25th document is an attachment."""
    text = F.when(F.col("item_id") % 8 == 0, "widget").otherwise(F.col("text"))
    queries = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), text.alias("query"))
    terms = queries.select("query_id", F.explode(F.array_distinct(_tokens("query"))).alias("term"))
    pages = table(spark, d, "part").select(F.concat(F.lit("part-"), "p_partkey").alias("slug"), F.col("p_name").alias("title"), F.concat_ws(" ", "p_type", "p_brand").alias("content"))
    lines = chunks(spark, d).withColumnRenamed("project_id", "title")
    excluded = lines.where("document_id % 25 = 0").select("chunk_id")
    words = lambda c: F.array_distinct(_tokens(c))
    found = r.hybrid(queries, terms, _asked_vectors(spark, d), pages, excluded, _posted(spark, d), _chunk_vectors(spark, d), lines, lambda q, c: r.jaccard(words(q), words(c)))
    return found.withColumn("rank", F.col("rank").cast("long"))


def _snapshots(spark, d):
    """Daily peak values by user group from the stream; the last batch wins."""
    daily = _stream(spark, d).groupBy(F.window("at", "1 day"), (F.col("user_id") % 20).alias("project_id")).agg(F.max("value").alias("score"))
    return st.run_once(daily.select(F.to_date("window.start").alias("day"), "project_id", "score"), "health", "complete")


QUERIES = {
    "x2_transcripts": _transcripts,
    "x2_repeats": _repeats,
    "x2_golden": _spoken,
    "x31_rules": _rules,
    "j10_cache_keys": _cache_keys,
    "j14_sign_off": _sign_off,
    "j16_register": _register,
    "j18_meetings": _meetings,
    "m14_approve": _approve,
    "m16_meeting_merge": _merge_meetings,
    "m17_payloads": _payloads,
    "a22_deliverables": _deliverables,
    "r7_vector_table": _vector_table,
    "r7_compaction": _compaction,
    "r22_hybrid": _hybrid,
    "r22_end_to_end": _end_to_end,
    "st6_snapshots": _snapshots,
}

_CLEAN = "[" + ", ".join(f"'{x}'" for _, x in SPOKEN) + "]"

ORACLES = {
    "x2_golden": f"select conv_id, turn, {_CLEAN}[length(text) % {len(SPOKEN)} + 1] as text from conversations",
    "x2_repeats": "select conv_id, turn, 'ok ' || case role when 'assistant' then 'ass' else role[1:3] end || ' noo' as text from conversations",
    "x31_rules": f"""with e as (select event_id, event_type as t, ['result empty ', '超时 ', 'not supported ', ''][cast(json_extract_string(props, '$.k') as int) % 4 + 1] || props as reason from events)
        select event_id, case when t = 'error' then case when contains(reason, 'empty') then '{logs.RULES["empty"]}' when contains(reason, '超时') then '{logs.RULES["timeout"]}' when contains(reason, 'not supported') then '{logs.RULES["unsupported"]}' else '{logs.RULES["exhausted"]}' || reason[1:80] end
            when t = 'view' then '{logs.RULES["replan"]}' || reason[1:80] when t = 'click' then '{logs.RULES["one_timeout"]}' else '{logs.RULES["other"]}' || reason[1:80] end as rule from e""",
    "j10_cache_keys": "select 'part-' || l_partkey as slug, count(distinct l_orderkey) as sources, min(l_orderkey) as first from lineitem where l_partkey in (select p_partkey from part) group by 1",
    "j14_sign_off": """with l as (select user_id % 20 as project_id, max_by(event_type, struct_pack(t := ts, e := event_id)) as last from events where event_type in ('purchase', 'error') group by 1)
        select o_custkey % 20 as project_id, case when o_orderstatus = 'P' and (last is null or last <> 'purchase') then 'pending' else 'done' end as status, count(*) as n from orders left join l on l.project_id = o_custkey % 20 group by 1, 2""",
    "j16_register": "select case when o_orderkey % 2 = 0 then '' else 'R-' end || o_orderkey as id, o_orderstatus as state from orders where o_orderstatus <> 'F'",
    "j18_meetings": "select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) as r from orders where contains(o_orderpriority, 'HIGH') and o_orderstatus = 'O') where r <= 2",
    "m14_approve": "select 'part-' || p_partkey as slug, case when p_size % 2 = 0 then cast(2 as bigint) else 1 end as version, case when p_partkey + (case when p_size % 2 = 0 then 2 else 1 end) in (select p_partkey from part) then 'part-' || (p_partkey + (case when p_size % 2 = 0 then 2 else 1 end)) else '' end as links from part",
    "m16_meeting_merge": """with x as (select o_orderkey, o_orderkey % 3 <> 0 as k, o_orderkey % 5 <> 0 as f, o_custkey from orders where o_orderkey % 3 <> 0 or o_orderkey % 5 <> 0),
        y as (select *, coalesce(case when k and o_orderkey % 2 = 0 then o_custkey end, case when f and o_orderkey % 4 = 1 then o_custkey + 1 end) as project from x)
        select o_orderkey, project, case when k and o_orderkey % 7 = 0 then 'ignored' when project is not null then 'linked' else 'unlinked' end as status from y""",
    "m17_payloads": "select event_id as id, case event_type when 'view' then 'ended' when 'click' then 'ongoing' else 'scheduled' end as status from events",
    "a22_deliverables": "select p_brand as phase, count(*) filter (where p_size % 4 = 0) as done, count(*) filter (where p_size % 4 = 1) as pending, count(*) filter (where p_size % 4 = 2) as missing, count(*) filter (where p_size % 4 = 3) as optional from part group by 1",
    "r7_compaction": """with v as (select *, cast(vec_id % 8 as int) as folder, (vec_id % 8 < 4 and vec_id // 8 % 3 = 0) or vec_id // 8 % 10 = 0 as gone from embeddings),
        c as (select folder, count(*) as stored, count(*) filter (where gone) as dead, count(*) filter (where not gone) as live_before, round(sum(cast(embedding[1] as double)) filter (where not gone), 4) as live_before_sum from v group by 1)
        select folder, stored, dead > 0.2 * stored as rewritten, case when dead > 0.2 * stored then live_before else stored end as stored_after, live_before, live_before_sum, live_before as live_after, live_before_sum as live_after_sum from c""",
    "r7_vector_table": """select vec_id, case when vec_id % 4 = 0 then -1 else label end as label, len(e) as dims, round(e[1], 6) as first, round(e[2], 6) as second, round(e[-1], 6) as last
        from (select vec_id, label, case when vec_id % 4 = 0 then list_reverse(cast(embedding as double[])) else cast(embedding as double[]) end as e from embeddings where vec_id % 10 <> 3)""",
    "r22_hybrid": f"""with {_FUSED}, cut as (select * from (select *, row_number() over (partition by query_id order by score desc, chunk_id) as r from fused) where r <= 10),
        nth as (select query_id, chunk_id, project_id as title, source, score, row_number() over (partition by query_id, project_id order by score desc, chunk_id) as nth from cut join chunks using (chunk_id))
        select query_id, chunk_id, title, source, rank from (select *, row_number() over (partition by query_id order by least(nth, 3), case when nth < 3 then title end nulls last, score desc, chunk_id) as rank from nth) where rank <= 5""",
    "r22_end_to_end": "with q as (select item_id as query_id, case when item_id % 8 = 0 then 'widget' else text end as query from benchmark), "
    + _BM25.replace("from chunks)", "from chunks where document_id % 25 <> 0)").replace("distinct item_id as query_id, unnest(regexp_extract_all(lower(text)", "distinct query_id, unnest(regexp_extract_all(lower(query)").replace("from benchmark)", "from q)")
    + """, m as (select query_id, 'part-' || p_partkey as slug, p_name as title, case when contains(lower(p_name), lower(query)) then 0.7::double else 0.4::double end as score from part join q on contains(lower(p_name), lower(query)) or contains(lower(p_type || ' ' || p_brand), lower(query))),
        pg as (select *, row_number() over (partition by query_id order by score desc, slug) as rank from m where query_id in (select query_id from m group by 1 having max(score) > 0.5)),
        vc as (select min(chunk_id) as chunk_id, any_value(embedding) as embedding from chunks join embeddings on vec_id = document_id where document_id % 25 <> 0 group by document_id),
        vs as (select query_id, chunk_id, round(list_cosine_similarity(cast(e.embedding as double[]), cast(vc.embedding as double[])), 6) as s from q join embeddings e on e.vec_id = query_id * 3, vc),
        nr as (select *, row_number() over (partition by query_id order by s desc, chunk_id) as rank from vs),
        fused as (select query_id, chunk_id, round(sum(part), 9) as score, case when count(distinct source) > 1 then 'both' else min(source) end as source from
            (select query_id, chunk_id, 2.0::double / (60 + rank) as part, 'vector' as source from nr where rank <= 200 union all select query_id, chunk_id, 1.0::double / (60 + rank), 'bm25' from bm where rank <= 200) where query_id not in (select query_id from pg) group by 1, 2),
        cut as (select * from (select *, row_number() over (partition by query_id order by score desc, chunk_id) as r from fused) where r <= 10),
        nth as (select query_id, chunk_id, project_id as title, content, source, score, row_number() over (partition by query_id, project_id order by score desc, chunk_id) as nth from cut join chunks using (chunk_id)),
        dv as (select * from (select *, row_number() over (partition by query_id order by least(nth, 3), case when nth < 3 then title end nulls last, score desc, chunk_id) as r from nth) where r <= 5),
        w as (select dv.*, list_distinct(regexp_extract_all(lower(query), '[a-z0-9]+')) as a, list_distinct(regexp_extract_all(lower(content), '[a-z0-9]+')) as b from dv join q using (query_id)),
        rr as (select query_id, chunk_id, title, source, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) as score from w)
        select query_id, chunk_id, cast(null as varchar) as slug, title, source, score, row_number() over (partition by query_id order by score desc, chunk_id) as rank from rr
        union all select query_id, null, slug, title, 'page', score, rank from pg where rank <= 5""",
    "st6_snapshots": "select cast(ts as date) as day, user_id % 20 as project_id, max(value) as score from events group by 1, 2",
}
