"""Retrieval queries: benchmark passages ask the chunks of all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import cells, chunking, index, lookups
from ..operators import retrieval as r
from ..sources.scratch import fresh_dir, stored
from .chunk_queries import CHUNKED
from .fixtures import CHUNKS, chunks, table

WORDS = r"[a-z0-9]+"


def _tokens(column="content"):
    return F.regexp_extract_all(F.lower(column), F.lit(WORDS), F.lit(0))


def _posted(spark, d):
    return stored(r.posting_lists(chunks(spark, d), _tokens()), "postings")


def _asked(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(F.array_distinct(_tokens("text"))).alias("term"))


def _bm25(spark, d, k=5):
    return r.bm25(_asked(spark, d), _posted(spark, d), k)


def _titled_lines(docs):
    """Lines of documents with a title: the beginning of the document's text."""
    lines = docs.select("doc_id", F.substring("text", 1, 60).alias("title"), F.posexplode(F.split("text", "\n")).alias("line_no", "content"))
    return lines.where(F.trim("content") != "").select((F.col("doc_id") * 2**31 + F.col("line_no")).alias("chunk_id"), "title", "content")


def _small_to_big(docs):
    """Chunks with their children below, under the document's title: (key, owner, parent_id, title, content)."""
    docs = docs.select("doc_id", "text", F.substring("text", 1, 60).alias("title"))
    number = F.col("doc_id") * 2**31 + F.col("chunk_no") * 4  # a chunk has at most three children
    rows = chunking.chunk_documents(docs, carried=["title"])
    return rows.select((number + F.col("child_no")).cast("long").alias("chunk_id"), number.cast("long").alias("owner"), F.when(F.col("child_no") > 0, number.cast("long")).alias("parent_id"), "title", "content")


def _fields():
    return {"title": _tokens("title"), "content": _tokens()}


def _indexed(docs, make, slots, owner=None, least=64 << 20):
    """The index of ``make`` of the documents, grown by two batches of them if each has ``least`` bytes of text: the lists on their way to blocks are half of all."""
    spark = docs.sparkSession
    batches = min(2, max(1, (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // least))
    path = fresh_dir(spark, "index")
    for batch in range(batches):
        made = index.build_index(make(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == batch)), _fields(), owner=owner, path=path, batch=batch, slots=slots)
    return made


def _indexed_lines(spark, d):
    docs = table(spark, d, "documents")
    return _indexed(docs, _titled_lines, max(1, -(-_titled_lines(docs).count() // (1 << 15))))


def _fielded(spark, d):
    return index.search(_indexed_lines(spark, d), _asked(spark, d)).withColumnRenamed("key", "chunk_id")


def _folded(spark, d):
    """Children are searched, parents found. Slots are counted by the texts' bytes, so chunks are made once and not written: 2^15 take about 5 MB."""
    docs = table(spark, d, "documents")
    slots = max(1, (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // (5 << 20))
    return index.search(_indexed(docs, _small_to_big, slots, "owner"), _asked(spark, d), fold=True).withColumnRenamed("key", "parent_id")


def _term_statistics(spark, d):
    blocks = _indexed_lines(spark, d).blocks
    return blocks.groupBy("term", "field").agg(F.sum("n").alias("df"), F.sum("cf").alias("cf"), F.max("max_tf").alias("max_tf"), F.min("min_length").alias("min_length"))


def _parents_of_children(spark, d):
    rows = _small_to_big(table(spark, d, "documents"))
    hits = rows.where(F.col("parent_id").isNotNull() & F.contains("content", F.lit("tion"))).select("chunk_id", "parent_id")
    return lookups.expand_to_parents(hits, rows).select("chunk_id", F.md5("content").alias("digest"))


def _postings(spark, d):
    return r.postings(_posted(spark, d)).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def _titled(spark, d, hits):
    """Hits with their chunk and the document's source as title; the hits are written, so that a small list of them meets the chunks without a shuffle."""
    return chunks(spark, d).select("chunk_id", "document_id", F.col("project_id").alias("title"), "content").join(stored(hits, "hits"), "chunk_id")


def _diverse(spark, d, mode="title_order"):
    return r.diversify(_titled(spark, d, _bm25(spark, d, 20)).drop("rank"), 5, mode=mode).select("query_id", "chunk_id", "title", "score", F.col("rank").cast("long").alias("rank"))


def _vectors(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "embedding")


def _nearest(spark, d, k=5):
    v = _vectors(spark, d)
    return r.nearest(v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), v, k)


def _approximate(spark, d):
    """Recall of the approximate search against the exact one."""
    v = _vectors(spark, d)
    asked = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    counts = cells.recall(cells.approximate_nearest(asked, v), _nearest(spark, d))
    return counts.select("queries", "wanted", (F.col("found") >= 0.9 * F.col("wanted")).alias("nine_tenths"))


def _chunk_vectors(spark, d):
    """The tables hold vectors of documents only: a document's stands for its first chunk."""
    first = chunks(spark, d).groupBy(F.col("document_id").alias("vec_id")).agg(F.min("chunk_id").alias("chunk_id"))
    return first.join(_vectors(spark, d), "vec_id").select("chunk_id", "embedding")


def _asked_vectors(spark, d):
    """A passage borrows the vector of three times its number."""
    ids = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"))
    return _vectors(spark, d).join(ids, F.expr("vec_id = query_id * 3")).select("query_id", F.col("embedding").alias("vector"))


def _fused(spark, d, posted=None):
    """Vectors and BM25 over the same chunks, fused by rank."""
    near = r.nearest(_asked_vectors(spark, d), _chunk_vectors(spark, d).withColumnRenamed("chunk_id", "vec_id"), r.CANDIDATES, itself=True).withColumnRenamed("vec_id", "chunk_id")
    return r.fuse({"vector": (near, r.VECTOR_WEIGHT), "bm25": (r.bm25(_asked(spark, d), _posted(spark, d) if posted is None else posted, r.CANDIDATES), r.TEXT_WEIGHT)})


def _phrases(spark, d):
    """A phrase table: the first two words of each passage."""
    return table(spark, d, "benchmark").select(F.regexp_extract(F.lower("text"), "^([a-z]+ [a-z]+)", 1).alias("phrase")).distinct()


def _phrase_postings(spark, d):
    lines = chunks(spark, d)
    lists = r.with_phrases(lines, _posted(spark, d), _phrases(spark, d), F.col("content"))
    return r.postings(lists).where(F.contains("term", F.lit(" "))).groupBy("term").agg(F.count("*").alias("df"), F.sum("dl").alias("words"))


def _keyword_profile(spark, d):
    """Passages as profiles: their distinct words are the keywords."""
    docs, asked = (table(spark, d, t).select(F.col(k).alias(i), F.lower("text").alias("text")) for t, k, i in (("documents", "doc_id", "doc_id"), ("benchmark", "item_id", "query_id")))
    scored = r.profile_match(asked, docs, lambda x: F.array_distinct(F.regexp_extract_all(x, F.lit(WORDS), F.lit(0))))
    return r.top(scored, 5, ["query_id"], [F.col("score").desc(), F.col("doc_id")]).drop("rank")


def _jaccard_pairs(spark, d):
    """Benchmark passages against the chunks that share a first line's words, by Jaccard over tokens."""
    hits = _titled(spark, d, _bm25(spark, d, 10)).join(table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")), "query_id")
    scorer = lambda q, c: r.jaccard(F.array_distinct(F.regexp_extract_all(F.lower(q), F.lit(WORDS), F.lit(0))), F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(WORDS), F.lit(0))))
    return r.rerank(hits, scorer, "query", "content", 5).select("query_id", "chunk_id", "score", F.col("rank").cast("long").alias("rank"))


def _gate(spark, d):
    hits = _nearest(spark, d, 3).select("query_id", F.col("similarity").alias("score"), "rank")
    return r.quality_gate(hits, _vectors(spark, d).where("vec_id % 25 = 0").select(F.col("vec_id").alias("query_id")))


def _expand(spark, d):
    return r.expand_queries(table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")), ["ERP", "the"], {"the": "a"})


def _shortcut(spark, d):
    pages = table(spark, d, "part").select(F.concat(F.lit("part-"), "p_partkey").alias("slug"), F.col("p_name").alias("title"), F.concat_ws(" ", "p_type", "p_brand").alias("content"))
    words = table(spark, d, "part").select(F.explode(F.array(F.substring_index("p_name", " ", 1), "p_brand")).alias("query"))
    queries = words.distinct().select(F.col("query").alias("query_id"), "query")
    return r.shortcut(queries, pages)


def _path_match(spark, d):
    pats = table(spark, d, "region").select(F.col("r_regionkey").alias("pattern_id"), F.element_at(F.array(F.lit("/en/"), F.lit("/de/"), F.lit("blog"), F.lit("#top"), F.lit("utm_source")), (F.col("r_regionkey") + 1).cast("int")).alias("pattern"))
    return lookups.match_paths(table(spark, d, "pages"), pats, F.col("url")).select("page_id", "pattern_id", "score")


QUERIES = {
    "search_bm25_diverse": _diverse,
    "r1_postings": _postings,
    "r2_postings_delete": lambda spark, d: r.postings(_posted(spark, d).where("chunk_id % 3 <> 0")).groupBy("project_id").agg(F.count("*").alias("n"), F.sum("tf").alias("tf")),
    "r3_bm25": lambda spark, d: _fielded(spark, d).withColumn("rank", F.col("rank").cast("long")),
    "r3_bm25_content": lambda spark, d: _bm25(spark, d).withColumn("rank", F.col("rank").cast("long")),
    "r1_index": _term_statistics,
    "c5_small_to_big": lambda spark, d: _folded(spark, d).withColumn("rank", F.col("rank").cast("long")),
    "j4_parents_of_children": _parents_of_children,
    "r4_phrase_tokens": lambda spark, d: table(spark, d, "documents").select("doc_id", F.size(F.filter(t.literals(["of the", "in the", "de la", "und der"]), lambda p: F.contains(F.lower("text"), p))).cast("long").alias("phrases")),
    "r4_phrase_postings": _phrase_postings,
    "r6_nearest": lambda spark, d: _nearest(spark, d).withColumn("rank", F.col("rank").cast("long")),
    "r6_approximate": _approximate,
    "r8_rank_fusion": _fused,
    "r10_candidate_cut": lambda spark, d: r.top(_fused(spark, d), 10, ["query_id"], [F.col("score").desc(), F.col("chunk_id")]).withColumn("rank", F.col("rank").cast("long")),
    "r11_diversity_by_score": lambda spark, d: _diverse(spark, d, "score"),
    "r12_shortcut": _shortcut,
    "r13_rerank_jaccard": _jaccard_pairs,
    "r14_quality_gate": _gate,
    "r16_expand": _expand,
    "r17_keyword_profile": _keyword_profile,
    "r18_semantic_profile": lambda spark, d: _nearest(spark, d, 10).where("10 * similarity >= 3.5").select("query_id", "vec_id", F.round(F.col("similarity") * 10, 5).alias("score")),
    "r19_path_match": _path_match,
    "r20_keywords": lambda spark, d: r.keywords(table(spark, d, "documents"), _tokens("text"), ["the", "of", "and", "de", "la"]).select("doc_id", "keyword", "score"),
    "r21_filter_results": lambda spark, d: _titled(spark, d, _bm25(spark, d)).where(F.contains(F.lower("title"), F.lit("src1"))).select("query_id", "chunk_id", "title"),
}

_POSTED = CHUNKS + """, posted as (select project_id, chunk_id, term, count(*) as tf from (select project_id, chunk_id, unnest(regexp_extract_all(lower(content), '[a-z0-9]+')) as term from chunks) group by 1, 2, 3)"""
_BM25 = _POSTED + """, asked as (select distinct item_id as query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as term from benchmark),
    dl as (select chunk_id, sum(tf) as dl from posted group by 1), df as (select term, count(*) as df from posted group by 1), whole as (select count(*) as n, avg(dl) as avgdl from dl),
    scored as (select query_id, chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) as score
        from asked join posted using (term) join dl using (chunk_id) join df using (term), whole group by 1, 2),
    bm as (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from scored)"""
_LINES = """rows as (select doc_id * 2147483648 + i - 1 as chunk_id, doc_id * 2147483648 + i - 1 as owner, substr(text, 1, 60) as title, content
    from (select doc_id, text, unnest(string_split(text, chr(10))) as content, unnest(range(1, len(string_split(text, chr(10))) + 1)) as i from documents) where trim(content) <> '')"""
_FAMILY = CHUNKED + """, rows as (select c.doc_id * 2147483648 + chunk_no * 4 + child_no as chunk_id, c.doc_id * 2147483648 + chunk_no * 4 as owner, child_no, substr(d.text, 1, 60) as title, content from chunked c join documents d on d.doc_id = c.doc_id)"""
_FIELDED = """, posted as (select chunk_id, owner, field, term, count(*) as tf from (select chunk_id, owner, 'title' as field, unnest(regexp_extract_all(lower(title), '[a-z0-9]+')) as term from rows
        union all select chunk_id, owner, 'content', unnest(regexp_extract_all(lower(content), '[a-z0-9]+')) from rows) group by all),
    asked as (select distinct item_id as query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as term from benchmark),
    dl as (select chunk_id, field, sum(tf) as dl from posted group by all), df as (select term, field, count(*) as df from posted group by all), whole as (select field, count(*) as n, avg(dl) as avgdl from dl group by all),
    scored as (select query_id, owner, chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) as score
        from asked join posted using (term) join dl using (chunk_id, field) join df using (term, field) join whole using (field) group by all)"""
_NEAR = """near as (select *, row_number() over (partition by query_id order by similarity desc, vec_id) as rank from
    (select q.vec_id as query_id, v.vec_id, round(list_cosine_similarity(cast(q.embedding as double[]), cast(v.embedding as double[])), 6) as similarity from embeddings q join embeddings v on q.vec_id <> v.vec_id where q.vec_id % 50 = 0))"""
_FUSED = _BM25 + """, vc as (select min(chunk_id) as chunk_id, any_value(embedding) as embedding from chunks join embeddings on vec_id = document_id group by document_id),
    vs as (select b.item_id as query_id, chunk_id, round(list_cosine_similarity(cast(e.embedding as double[]), cast(vc.embedding as double[])), 6) as s from benchmark b join embeddings e on e.vec_id = b.item_id * 3, vc),
    nr as (select *, row_number() over (partition by query_id order by s desc, chunk_id) as rank from vs),
    fused as (select query_id, chunk_id, round(sum(part), 9) as score, case when count(distinct source) > 1 then 'both' else min(source) end as source from
        (select query_id, chunk_id, 2.0::double / (60 + rank) as part, 'vector' as source from nr where rank <= 200 union all select query_id, chunk_id, 1.0::double / (60 + rank), 'bm25' from bm where rank <= 200) group by 1, 2)"""
_DIVERSE = _BM25 + """, titled as (select query_id, chunk_id, project_id as title, score, row_number() over (partition by query_id, project_id order by score desc, chunk_id) as nth from bm join chunks using (chunk_id) where rank <= 20)"""

ORACLES = {
    "search_bm25_diverse": f"""with {_DIVERSE} select query_id, chunk_id, title, score, rank from (select *, row_number() over (partition by query_id order by least(nth, 3), case when nth < 3 then title end nulls last, score desc, chunk_id) as rank from titled) where rank <= 5""",
    "r11_diversity_by_score": f"""with {_DIVERSE} select query_id, chunk_id, title, score, rank from (select *, row_number() over (partition by query_id order by least(nth, 3), score desc, chunk_id) as rank from titled) where rank <= 5""",
    "r1_postings": f"with {_POSTED} select term, count(*) as df, cast(sum(tf) as bigint) as cf from posted group by 1",
    "r2_postings_delete": f"with {_POSTED} select project_id, count(*) as n, cast(sum(tf) as bigint) as tf from posted where chunk_id % 3 <> 0 group by 1",
    "r3_bm25": f"with {_LINES}{_FIELDED} select * exclude (owner) from (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from scored) where rank <= 5",
    "c5_small_to_big": f"""with {_FAMILY}{_FIELDED}, best as (select query_id, owner as parent_id, max(score) as score from scored group by all)
        select * from (select *, row_number() over (partition by query_id order by score desc, parent_id) as rank from best) where rank <= 5""",
    "r1_index": f"""with {_LINES}{_FIELDED} select term, field, count(*) as df, cast(sum(tf) as bigint) as cf, max(tf) as max_tf, cast(min(dl) as bigint) as min_length from posted join dl using (chunk_id, field) group by all""",
    "j4_parents_of_children": f"""with {_FAMILY} select chunk_id, md5(content) as digest from rows where child_no = 0 and owner in (select owner from rows where child_no > 0 and contains(content, 'tion'))""",
    "r3_bm25_content": f"with {_BM25} select query_id, chunk_id, score, rank from bm where rank <= 5",
    "r4_phrase_tokens": "select doc_id, cast(contains(lower(text), 'of the') as bigint) + cast(contains(lower(text), 'in the') as bigint) + cast(contains(lower(text), 'de la') as bigint) + cast(contains(lower(text), 'und der') as bigint) as phrases from documents",
    "r6_nearest": f"with {_NEAR} select query_id, vec_id, similarity, rank from near where rank <= 5",
    "r6_approximate": "select count(*) as queries, cast(sum(least(n - 1, 5)) as bigint) as wanted, true as nine_tenths from embeddings, (select count(*) as n from embeddings) where vec_id % 50 = 0",
    "r8_rank_fusion": f"with {_FUSED} select * from fused",
    "r10_candidate_cut": f"with {_FUSED} select * from (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from fused) where rank <= 10",
    "r12_shortcut": """with q as (select distinct x as query_id, x as query from (select string_split(p_name, ' ')[1] as x from part union all select p_brand from part)),
        s as (select query_id, 'part-' || p_partkey as slug, case when contains(lower(p_name), lower(query)) then 0.7::double else 0.4::double end as score from part join q on contains(lower(p_name), lower(query)) or contains(lower(p_type || ' ' || p_brand), lower(query)))
        select * from s where query_id in (select query_id from s group by 1 having max(score) > 0.5)""",
    "r13_rerank_jaccard": f"""with {_BM25}, hits as (select query_id, chunk_id, list_distinct(regexp_extract_all(lower(b.text), '[a-z0-9]+')) as q, list_distinct(regexp_extract_all(lower(content), '[a-z0-9]+')) as c
            from bm join chunks using (chunk_id) join benchmark b on b.item_id = query_id where rank <= 10),
        s as (select query_id, chunk_id, round(len(list_intersect(q, c)) / len(list_distinct(list_concat(q, c))), 6) as score from hits)
        select * from (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from s) where rank <= 5""",
    "r14_quality_gate": f"""with {_NEAR}, s as (select query_id, max(similarity) as best, avg(similarity) as mean3 from near where rank <= 3 group by 1),
        r as (select vec_id as query_id, concat_ws(',', case when best is null then 'empty' end, case when best < 0.3 then 'low_top' end, case when mean3 < 0.2 then 'low_mean' end) as reasons from embeddings left join s on vec_id = query_id where vec_id % 25 = 0)
        select query_id, reasons = '' as sufficient, reasons from r""",
    "r16_expand": """with q as (select item_id as query_id, text as q from benchmark)
        select distinct query_id, variant from (select query_id, unnest([q, case when not contains(q, 'ERP') then 'ERP ' || q end, case when not contains(q, 'the') then 'the ' || q end, case when replace(q, 'the', 'a') <> q then replace(q, 'the', 'a') end]) as variant from q) where variant is not null""",
    "r4_phrase_postings": f"""with {CHUNKS}, ph as (select distinct p from (select regexp_extract(lower(text), '^([a-z]+ [a-z]+)', 1) as p from benchmark) where p <> '')
        select p as term, count(*) as df, cast(sum(len(regexp_extract_all(lower(content), '[a-z0-9]+'))) as bigint) as words from chunks join ph on contains(lower(content), p) group by 1""",
    "r17_keyword_profile": """with q as (select item_id as query_id, lower(text) as qt, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) as qk from benchmark), dc as (select doc_id, lower(text) as dt, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) as dk from documents),
        s as (select query_id, doc_id, len(list_intersect(qk, dk)) as shared, len(qk) as nq, len(dk) as nd, contains(qt, dt) or contains(dt, qt) as within from q, dc),
        sc as (select query_id, doc_id, round(shared + case when shared / (nq + nd - shared) > 0.3 then 3 * shared / (nq + nd - shared) else 0 end + case when within then 5 else 0 end, 6) as score from s where shared > 0)
        select query_id, doc_id, score from (select *, row_number() over (partition by query_id order by score desc, doc_id) as r from sc) where r <= 5""",
    "r18_semantic_profile": f"with {_NEAR} select query_id, vec_id, round(similarity * 10, 5) as score from near where rank <= 10 and 10 * similarity >= 3.5",
    "r19_path_match": "select page_id, cast(i - 1 as int) as pattern_id, 5.0::double as score from pages, (select unnest(['/en/', '/de/', 'blog', '#top', 'utm_source']) as p, unnest(range(1, 6)) as i) where contains(lower(url), p)",
    "r20_keywords": """with k as (select doc_id, k, count(*) as n from (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as k from documents) where length(k) >= 2 and k not in ('the', 'of', 'and', 'de', 'la') group by 1, 2),
        s as (select doc_id, k as keyword, round(n / sum(n) over (partition by doc_id) * ln(1 + sum(n) over (partition by doc_id) / n), 6) as score from k)
        select doc_id, keyword, score from (select *, row_number() over (partition by doc_id order by score desc, keyword) as r from s) where r <= 20""",
    "r21_filter_results": f"with {_BM25} select query_id, chunk_id, project_id as title from bm join chunks using (chunk_id) where rank <= 5 and contains(lower(project_id), 'src1')",
}
