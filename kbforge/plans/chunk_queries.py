"""Chunking queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import chunking as c
from .fixtures import CHUNKS, chunks, table
from .text_queries import _headings


def _marked(spark, d):
    """Documents whose every third line is a section heading."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 3 == 2, F.concat(F.lit("## "), x)).otherwise(x))
    return table(spark, d, "documents").select("doc_id", F.array_join(lines, "\n").alias("text"))


def _sections(spark, d):
    return c.sections(_marked(spark, d)).select("doc_id", "section_no", "heading", "start", F.md5("content").alias("digest"))


def _windows(spark, d):
    return c.windows(table(spark, d, "documents"), 1600, 160).select("doc_id", "window_no", F.md5("content").alias("digest"))


def _chunks(spark, d):
    return c.chunk_documents(table(spark, d, "documents").select("doc_id", "text"))


def _batches(spark, d):
    pieces = chunks(spark, d).withColumn("tokens", t.token_estimate(F.col("content")).cast("long"))
    return c.budget_batches(pieces, 220).groupBy("document_id", "batch_no").agg(F.count("*").alias("pieces"), F.sum("tokens").alias("tokens"))


def _merge(spark, d):
    parts = c.windows(table(spark, d, "documents"), 1600, 160).select("doc_id", "window_no", F.regexp_extract_all("content", F.lit("[A-Z][a-z]+"), F.lit(0)).alias("names"))
    return c.merge_partials(parts, "doc_id", "window_no", "names").select("doc_id", F.size("merged").cast("long").alias("names"), F.md5(F.array_join("merged", " ")).alias("digest"))


def _tree(spark, d):
    return c.heading_tree(_headings(spark, d)).select("doc_id", "line_no", "level", "parent")


QUERIES = {
    "c1_sections": _sections,
    "c2_c5_chunks": _chunks,
    "c6_windows": _windows,
    "c7_budget_batches": _batches,
    "c8_merge_partials": _merge,
    "c9_heading_tree": _tree,
}

_WINDOWS = """windows as (select doc_id, w as window_no, substring(text, cast(w * 1440 + 1 as int), 1600) as content
    from (select doc_id, text, unnest(range(0, cast(greatest(ceil((length(text) - 160) / 1440.0), 1) as bigint))) as w from documents where length(text) > 0))"""
_HEADINGS = r"""headings as (select doc_id, cast(i - 1 as bigint) as line_no, cast(len(string_split(line, ' ')) as bigint) as level
        from (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(1, len(string_split(text, chr(10))) + 1)) as i from documents)
        where len(string_split(line, ' ')) <= 6 and trim(line) <> '')"""

_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_NONE = "cast([] as varchar[])"
_ENDERS = c.ENDERS.replace("\n", "\\n")


def _fold(items, step):
    """A fold over texts; its state is the finished texts and the open one."""
    start = f"{{'done': {_NONE}, 'cur': ''}}"
    return f"list_reduce(list_prepend({start}, [{{'done': {_NONE}, 'cur': s}} for s in {items}]), lambda a, b: {step})"


def _packed_sentences(text, target):
    step = f"case when a.cur <> '' and strlen(a.cur) + strlen(b.cur) > {target} then {{'done': list_append(a.done, a.cur), 'cur': b.cur}} else {{'done': a.done, 'cur': a.cur || b.cur}} end"
    pieces = f"regexp_extract_all({text}, '[^{_ENDERS}]*[{_ENDERS}]|[^{_ENDERS}]+')"
    return f"[trim(s, {_BLANK}) for s in [list_append(z.done, z.cur) for z in [{_fold(pieces, step)}]][1] if trim(s, {_BLANK}) <> '']"


_PACK = f"""case when strlen(b.cur) > {c.TARGET} then {{'done': list_concat(case when a.cur = '' then a.done else list_append(a.done, a.cur) end, {_packed_sentences("b.cur", c.TARGET)}), 'cur': ''}}
    when a.cur <> '' and strlen(a.cur) + 1 + strlen(b.cur) > {c.TARGET}
        then {{'done': list_append(a.done, a.cur), 'cur': case when floor(length(a.cur) * {c.OVERLAP}::double) > 0 then right(a.cur, cast(floor(length(a.cur) * {c.OVERLAP}::double) as int)) || chr(10) || b.cur else b.cur end}}
    else {{'done': a.done, 'cur': case when a.cur = '' then b.cur else a.cur || chr(10) || b.cur end}} end"""
_LEVEL = f"""case when a.cur = '' then b when (strlen(a.cur) < {c.SMALL} or strlen(b.cur) < {c.SMALL}) and strlen(a.cur) + 1 + strlen(b.cur) <= {c.LARGE} then {{'done': a.done, 'cur': a.cur || chr(10) || b.cur}}
    else {{'done': list_append(a.done, a.cur), 'cur': b.cur}} end"""

CHUNKED = f"""p as (select doc_id, [trim(x, {_BLANK}) for x in string_split(coalesce(text, ''), chr(10)) if trim(x, {_BLANK}) <> ''] as ps from documents),
        packed as (select doc_id, case when r.cur = '' then r.done else list_append(r.done, r.cur) end as cs from (select doc_id, {_fold("ps", _PACK)} as r from p)),
        levelled as (select doc_id, list_append(r.done, r.cur) as cs from (select doc_id, {_fold("cs", _LEVEL)} as r from packed where len(cs) > 0)),
        cut as (select doc_id, flatten([case when strlen(x) > {c.LARGE} then {_packed_sentences("x", c.LARGE)} else [x] end for x in cs]) as cs from levelled),
        ch as (select doc_id, unnest(cs) as content, unnest(range(len(cs))) as chunk_no from cut),
        kids as (select doc_id, chunk_no, [s for s in {_packed_sentences("content", c.CHILD_SIZE)} if length(s) >= {c.CHILD_MIN}][1:{c.CHILDREN}] as ks from ch
            where length(content) >= {c.PARENT_MIN} and len(regexp_extract_all(content, '[{_ENDERS}]')) >= 2),
        chunked as (select doc_id, chunk_no, cast(0 as bigint) as child_no, content from ch union all select doc_id, chunk_no, unnest(range(1, len(ks) + 1)), unnest(ks) from kids)"""

ORACLES = {
    "c1_sections": """with lines as (select doc_id, i - 1 as n, case when i % 3 = 0 then '## ' || line else line end as line
            from (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(1, len(string_split(text, chr(10))) + 1)) as i from documents)),
        numbered as (select *, sum(case when line like '## %' then 1 else 0 end) over w as section_no, coalesce(sum(length(line) + 1) over (partition by doc_id order by n rows between unbounded preceding and 1 preceding), 0) as pos
            from lines window w as (partition by doc_id order by n)),
        whole as (select doc_id, cast(section_no as bigint) as section_no, max(case when line like '## %' then trim(line[4:]) end) as heading, cast(min(pos) as bigint) as start,
            trim(coalesce(string_agg(case when line not like '## %' then line end, chr(10) order by n), ''), ' ' || chr(10)) as content from numbered group by 1, 2)
        select doc_id, section_no, heading, start, md5(content) as digest from whole where content <> ''""",
    "c2_c5_chunks": f"with {CHUNKED} select * from chunked",
    "c6_windows": f"with {_WINDOWS} select doc_id, window_no, md5(content) as digest from windows",
    "c7_budget_batches": rf"""with recursive {CHUNKS}, p as (select document_id, row_number() over (partition by document_id order by line_no) as r, cast(ceil(w / 1.2::double + (strlen(content) - w) / 3.5::double) as bigint) as tokens
            from (select *, length(regexp_replace(content, '[\x00-\x7f]', '', 'g')) as w from chunks)),
        b as (select document_id, r, tokens, tokens as used, cast(0 as bigint) as batch_no from p where r = 1
            union all select p.document_id, p.r, p.tokens, case when used > 0 and used + p.tokens > 220 then p.tokens else used + p.tokens end, batch_no + case when used > 0 and used + p.tokens > 220 then 1 else 0 end from b join p on p.document_id = b.document_id and p.r = b.r + 1)
        select document_id, batch_no, count(*) as pieces, cast(sum(tokens) as bigint) as tokens from b group by 1, 2""",
    "c8_merge_partials": f"""with {_WINDOWS}, each as (select doc_id, window_no, unnest(k) as v, unnest(range(len(k))) as i from (select doc_id, window_no, regexp_extract_all(content, '[A-Z][a-z]+') as k from windows)),
        firsts as (select doc_id, v, min(window_no * 1000000 + i) as pos from each group by 1, 2)
        select doc_id, count(*) as names, md5(string_agg(v, ' ' order by pos)) as digest from firsts group by doc_id""",
    "c9_heading_tree": f"""with {_HEADINGS} select h.doc_id, h.line_no, h.level, (select max(p.line_no) from headings p where p.doc_id = h.doc_id and p.line_no < h.line_no and p.level < h.level) as parent from headings h""",
}
