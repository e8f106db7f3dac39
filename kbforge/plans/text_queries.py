"""Projections and scalar text functions over the whole corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators.chunking import headings, outline_rows
from .fixtures import table

STOP_TAGS = ["src", "the", "of", "and"]


def _docs(make):
    return lambda spark, d: table(spark, d, "documents").select("doc_id", make(F.col("text")))


def _pages(make):
    return lambda spark, d: table(spark, d, "pages").select("page_id", make())


def _headings(spark, d):
    """Lines of one to six words as headings, their level by the number of words."""
    mark = F.transform(F.split("text", "\n"), lambda x: F.concat(F.repeat(F.lit("#"), F.least(F.size(F.split(x, " ")), F.lit(9))), F.lit(" "), x))
    return headings(table(spark, d, "documents").select("doc_id", F.array_join(mark, "\n").alias("text")))


def _page_headings(spark, d):
    """Titles, headings and list items of pages as Markdown, and the headings found in it."""
    text = F.regexp_replace("html", "<title>", "\n# ")
    text = F.regexp_replace(F.regexp_replace(text, "<h1>", "\n## "), "<li>", "\n####### ")
    text = F.regexp_replace(F.regexp_replace(text, "<p>", "\n### "), "</title>|</h1>|</li>|<br>", "\n")
    return headings(table(spark, d, "pages").select("page_id", text.alias("text")), "page_id").select("page_id", "line_no", "level", F.md5("heading").alias("heading"))


def _sentences(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(t.sentences(F.col("text"))).alias("n", "sentence")).groupBy("doc_id").agg(F.count("*").alias("sentences"), F.sum(F.char_length("sentence")).alias("chars"))


def _outline(spark, d):
    """Lines that begin with A-H open a section, those with I-N a category, others are questions, prose or blank lines none; sections and categories are carried down."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line"))
    number = F.when(F.col("line").rlike("^[A-H]"), "1 ").when(F.col("line").rlike("^[I-N]"), "12.3 ").when(F.col("line").rlike("^[O-Z]"), "1.10.2 ").otherwise("1.2.3.4 ")
    return outline_rows(lines.select("doc_id", "p", F.concat(number, "line").alias("line")), ["doc_id"], "p", "line")


def _answer():
    """A model's answer that holds an event's payload: in a fence, bare in prose, or in a nested object."""
    shape = F.col("event_id") % 3
    fence, bare = F.concat(F.lit("Result: ```json\n"), "props", F.lit("\n``` done {x}")), F.concat(F.lit("The answer is "), "props", F.lit(" as asked"))
    return F.when(shape == 0, fence).when(shape == 1, bare).otherwise(F.concat(F.lit("So: "), F.regexp_replace("props", r"\}$", ', "in": {"k": 1}}'), F.lit(".")))


def _sources(spark, d):
    """An order's lines as a JSON array of sources: numbers, texts, blanks and nulls."""
    k = F.col("l_linenumber")
    source = F.when(k % 4 == 0, F.col("l_partkey").cast("string")).when(k % 4 == 1, F.concat(F.lit('" p'), "l_partkey", F.lit('"'))).when(k % 4 == 2, F.lit('"  "')).otherwise(F.lit("null"))
    one = F.concat(F.lit('{"source_id": '), source, F.lit(', "document_id": '), "l_suppkey", F.lit("}"))
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.concat(F.lit("["), F.array_join(F.collect_list(one), ", "), F.lit("]")).alias("sources"))


def _salvage(spark, d):
    """Two items with the first line of a text as a JSON array that breaks off inside the third; the first line may hold braces and quotes."""
    line = F.concat(F.lit("{"), F.substring_index("text", "\n", 1), F.lit('" }'))
    item = lambda n: F.to_json(F.struct(F.lit(n).alias("n"), F.struct(line.alias("name")).alias("item")))
    broken = F.concat(F.lit("Items: ["), item(1), F.lit(", "), item(2), F.lit(", "), F.expr("substring(to_json(struct(3 as n, text as name)), 1, 12)"))
    rows = table(spark, d, "documents").select("doc_id", F.explode(t.whole_objects(broken)).alias("object"))
    return rows.select("doc_id", F.from_json("object", "n int, item struct<name: string>").alias("x")).select("doc_id", "x.n", F.md5("x.item.name").alias("digest"))


#: Masks, placeholders and deletions in turn over the kinds; what has no policy stays.
POLICIES = [{"card": "mask", "phone": "mask", "email": "mask"}, {"card": "placeholder", "phone": "delete", "email": "placeholder"}, {"card": "delete", "phone": "placeholder", "email": "delete"}, {"email": "delete"}]


def _policies(spark, d):
    """Each text under each policy, with what is left of the kinds that the policy covers."""
    docs, found = table(spark, d, "documents").select("doc_id", "text"), None
    for number, policies in enumerate(POLICIES):
        safe = docs.select("doc_id", F.lit(number).alias("policy"), t.sanitise(F.col("text"), policies).alias("safe"))
        part = safe.select("doc_id", "policy", F.md5("safe").alias("digest"), t.residue(F.col("safe"), list(policies)).alias("residue"))
        found = part if found is None else found.unionByName(part)
    return found


def _sanitised(policies):
    text = "text"
    for kind, pattern in t.SENSITIVE.items():
        if kind in policies:
            put = {"mask": r"\1***\2", "placeholder": f"[{kind.upper()}]", "delete": ""}[policies[kind]]
            text = f"regexp_replace({text}, '{pattern}', '{put}', 'g')"
    return f"select doc_id, {POLICIES.index(policies)} as policy, md5({text}) as digest, cast(0 as bigint) as residue from documents"


QUERIES = {
    "s2_html_text": _pages(lambda: t.html_text(F.col("html")).alias("text")),
    "x1_clean_markup": _pages(lambda: t.clean_markup(F.col("html")).alias("text")),
    "x3_content_hash": _docs(lambda x: t.content_hash(x).alias("sha256")),
    "x4_title": lambda spark, d: table(spark, d, "documents").select("doc_id", t.title_of(F.col("text"), F.concat(F.lit("doc-"), "doc_id")).alias("title")),
    "x5_title_from_name": _pages(lambda: t.title_from_name(F.regexp_extract("url", "([^/]*)$", 1)).alias("title")),
    "x6_tags": _pages(lambda: t.tags_of(F.regexp_extract("url", "([^/]*)$", 1), F.concat(F.lit("site > page "), "page_id"), STOP_TAGS).alias("tags")),
    "x7_slugify": lambda spark, d: table(spark, d, "part").select("p_partkey", t.slugify(F.concat_ws(" ", "p_name", "p_type", "p_brand")).alias("slug")),
    "x8_counts": lambda spark, d: table(spark, d, "documents").select("doc_id", t.word_count(F.col("text")).cast("long").alias("words"), F.char_length("text").cast("long").alias("chars")),
    "x9_language_class": _docs(lambda x: t.language_class(x).alias("language")),
    "x10_ngram_tokens": lambda spark, d: table(spark, d, "documents").select("doc_id", t.ngram_tokens(F.col("text")).alias("k")).select("doc_id", F.size("k").cast("long").alias("tokens"), F.md5(F.array_join("k", " ")).alias("digest")),
    "x11_entities": _docs(lambda x: F.array_join(F.array_sort(t.entities(x)), ",").alias("entities")),
    "x12_headings": _headings,
    "x12_page_headings": _page_headings,
    "x13_outline": _outline,
    "x14_sentences": _sentences,
    "x15_keep_separators": _docs(lambda x: F.size(t.keep_separators(F.translate(x, ".", "。"))).cast("long").alias("pieces")),
    "x16_token_estimate": lambda spark, d: table(spark, d, "documents").select("doc_id", t.token_estimate(F.col("text")).cast("long").alias("tokens"), F.floor(t.token_estimate(F.col("text"), 1.5, 4.0)).cast("long").alias("tokens_2")),
    "x17_truncate": _docs(lambda x: t.truncate_to_budget(x, 100).alias("text")),
    "x17_preview": _docs(lambda x: t.preview(x, 50).alias("preview")),
    "x18_context_prefix": lambda spark, d: table(spark, d, "documents").select("doc_id", t.context_prefix(F.col("source"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")), F.col("text")).alias("text")).select("doc_id", F.md5("text").alias("digest")),
    "x20_citations": lambda spark, d: table(spark, d, "conversations").select("conv_id", "turn", F.concat_ws(",", t.citations(F.concat(F.regexp_replace("text", r"([a-z]{5,})\.", "[来源：$1.md]"), F.lit(" [src:"), "turn", F.lit("] [chunk:"), F.regexp_count("text", F.lit("the")), F.lit("]")))).alias("cited")),
    "x21_answer_json": lambda spark, d: table(spark, d, "events").select("event_id", F.from_json(t.json_of_answer(_answer()), "k long").getField("k").alias("k")),
    "x22_front_matter": lambda spark, d: table(spark, d, "documents").select("doc_id", F.concat_ws("|", t.front_matter_tags(F.concat(F.lit('---\nsource: x\ntags: [a, "'), F.regexp_extract("text", "([a-z]+)", 1), F.lit('", '), F.regexp_extract("text", "([a-z]+)[^a-z]*$", 1), F.lit("]\n---\n"), "text"))).alias("tags")),
    "x23_source_keys": lambda spark, d: _sources(spark, d).select("l_orderkey", F.array_join(t.source_keys(F.col("sources")), ",").alias("keys")),
    "x21_salvage": _salvage,
    "x24_injection_phrase": lambda spark, d: table(spark, d, "documents").select("doc_id", t.first_injection_phrase(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit(" Act as if"))).otherwise(F.col("text"))).alias("phrase")),
    "x25_scrub_context": lambda spark, d: table(spark, d, "conversations").select("conv_id", "turn", F.md5(t.scrub_context(F.concat(F.regexp_replace("text", "([a-z]{6,})", "<context>$1\n</context>"), F.when(F.col("turn") % 2 == 0, F.concat(F.lit("<context>"), "text")).otherwise(F.lit(""))))).alias("digest")),
    "x28_policies": _policies,
    "x28_masking": _docs(lambda x: F.md5(t.mask_digits(x)).alias("digest")),
    "x29_change_ratio": lambda spark, d: table(spark, d, "part").select("p_partkey", F.round(t.change_ratio(F.col("p_name"), F.concat_ws(" ", "p_type", "p_name")), 6).alias("ratio")),
    "x30_failure_words": lambda spark, d: table(spark, d, "conversations").select("conv_id", "turn", t.has_failure_word(F.concat("text", F.when(F.col("turn") == 1, F.lit(" Error")).otherwise(F.lit("")))).alias("failed")),
}

# Written out for the twins, so that they do not follow the library's lists.
_phrases = """['ignore previous instructions', 'ignore above instructions', 'disregard all prior', 'you are now', 'system prompt', 'act as if', 'pretend you are',
    'forget your instructions', 'override your rules', 'bypass your guidelines', '忽略之前的指令', '忽略以上指令', '你现在是', '系统提示词']"""
_failures = "['失败', '错误', '不支持', '无法', '遇到问题', '未能完成', 'failed', 'error', 'not supported', 'unable', 'cannot', 'blocked', 'exception']"

ORACLES = {
    "s2_html_text": r"select page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', ' ', 'g'), '<[^>]+>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g')) as text from pages",
    "x1_clean_markup": r"""select page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '!\[[^\]]*\]\([^)]*\)', '', 'g'), '\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '<[^>]+>', '', 'g'), '[ \t\r]+', ' ', 'g'), ' +\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10)) as text from pages""",
    "x3_content_hash": "select doc_id, sha256(text) as sha256 from documents",
    "x4_title": r"""select doc_id, case when t <> '' and length(t) <= 120 and not regexp_matches(t, '[\x00-\x1f\x7f]') then t else 'doc-' || doc_id end as title
        from (select doc_id, case when regexp_extract(text, '(?m)^# +([^\n]+)$', 1) <> '' then trim(regexp_extract(text, '(?m)^# +([^\n]+)$', 1)) else trim(regexp_extract(text, '^[ \t\r\n]*([^\n]+)', 1)) end as t from documents)""",
    "x5_title_from_name": r"select page_id, trim(regexp_replace(regexp_replace(regexp_extract(url, '([^/]*)$', 1), '\.[A-Za-z0-9]+$', ''), '[-_ ]+', ' ', 'g')) as title from pages",
    "x6_tags": r"""select page_id, list_sort(list_distinct([trim(x) for x in regexp_split_to_array(regexp_replace(regexp_extract(url, '([^/]*)$', 1), '\.[A-Za-z0-9]+$', ''), '[-_ ]') || ['site', 'page ' || page_id] if strlen(trim(x)) >= 2 and lower(trim(x)) not in ('src', 'the', 'of', 'and')])) as tags from pages""",
    "x7_slugify": r"select p_partkey, trim(regexp_replace(lower(p_name || ' ' || p_type || ' ' || p_brand), '[\x00-\x2f\x3a-\x60\x7b-\x7f]+', '-', 'g'), '-') as slug from part",
    "x8_counts": r"select doc_id, len(regexp_extract_all(text, '[\x{4e00}-\x{9fff}]+|[A-Za-z0-9]+')) as words, length(text) as chars from documents",
    "x9_language_class": r"""select doc_id, case when n = 0 then 'unknown' when c / n > 0.3 then 'zh' when c / n > 0.05 then 'zh-en' else 'en' end as language
        from (select doc_id, length(regexp_replace(text, '[ \t\r\n]', '', 'g')) as n, len(regexp_extract_all(text, '[\x{4e00}-\x{9fff}]')) as c from documents)""",
    "x10_ngram_tokens": "select doc_id, len(k) as tokens, md5(array_to_string(k, ' ')) as digest from (select doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') as k from documents)",
    "x11_entities": r"select doc_id, array_to_string(list_sort(list_distinct([x for x in regexp_extract_all(text, '[A-Za-z]+') if regexp_full_match(x, '[A-Z]{2,10}')])), ',') as entities from documents",
    "x12_headings": r"""select doc_id, cast(i - 1 as bigint) as line_no, cast(len(string_split(line, ' ')) as bigint) as level, trim(line) as heading
        from (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(1, len(string_split(text, chr(10))) + 1)) as i from documents)
        where len(string_split(line, ' ')) <= 6 and trim(line) <> ''""",
    "x12_page_headings": r"""with m as (select page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<title>', chr(10) || '# ', 'g'), '<h1>', chr(10) || '## ', 'g'), '<li>', chr(10) || '####### ', 'g'), '<p>', chr(10) || '### ', 'g'), '</title>|</h1>|</li>|<br>', chr(10), 'g') as x from pages),
        l as (select page_id, unnest(string_split(x, chr(10))) as x, unnest(range(len(string_split(x, chr(10))))) as line_no from m)
        select page_id, line_no, length(regexp_extract(x, '^(#+) ', 1)) as level, md5(trim(regexp_extract(x, '^#+ +(.*)$', 1))) as heading from l where regexp_matches(x, '^#{1,6} +[^ ]')""",
    "x13_outline": """with l as (select doc_id, i as p, trim(line) as line, case when regexp_matches(line, '^[A-H]') then 1 when regexp_matches(line, '^[I-N]') then 2 when regexp_matches(line, '^[O-Z]') then 3 end as lv from (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as i from documents)),
        q as (select * from l where lv = 3), s as (select q.doc_id, q.p, q.line as question, max(s.p) as sp from q left join l s on s.doc_id = q.doc_id and s.p < q.p and s.lv = 1 group by 1, 2, 3),
        c as (select s.*, (select max(k.p) from l k where k.doc_id = s.doc_id and k.lv = 2 and k.p < s.p and k.p > coalesce(s.sp, -1)) as cp from s)
        select c.doc_id, row_number() over (partition by c.doc_id order by c.p) as ordinal, a.line as section, b.line as category, question from c left join l a on a.doc_id = c.doc_id and a.p = c.sp left join l b on b.doc_id = c.doc_id and b.p = c.cp""",
    "x15_keep_separators": "select doc_id, cast(len(regexp_extract_all(x, '[。！？；]')) + case when x = '' or right(x, 1) in ('。', '！', '？', '；') then 0 else 1 end as bigint) as pieces from (select doc_id, translate(text, '.', '。') as x from documents)",
    "x17_truncate": r"""with n as (select doc_id, text, unnest(range(0, least(length(text), 400) + 1)) as n from documents), e as (select *, length(regexp_replace(text[1:n], '[\x00-\x7f]', '', 'g')) as w from n)
        select doc_id, max_by(text[1:n], n) as text from e where ceil(w / 1.2::double + (strlen(text[1:n]) - w) / 3.5::double) <= 100 group by doc_id""",
    "x16_token_estimate": r"""select doc_id, cast(ceil(n / 1.2::double + (strlen(text) - n) / 3.5::double) as bigint) as tokens, cast(ceil(n / 1.5::double + (strlen(text) - n) / 4.0::double) as bigint) as tokens_2
        from (select doc_id, text, length(regexp_replace(text, '[\x00-\x7f]', '', 'g')) as n from documents)""",
    "x17_preview": "select doc_id, case when length(text) > 50 then text[1:50] || '...' else text end as preview from documents",
    "x18_context_prefix": "select doc_id, md5('文档《' || source || '》' || case when doc_id % 2 = 0 then ' ' || lang || '章节' else '' end || chr(10) || text) as digest from documents",
    "x20_citations": r"select conv_id, turn, array_to_string(list_append(list_append([x || '.md' for x in regexp_extract_all(text, '([a-z]{5,})\.', 1)], cast(turn as varchar)), cast(len(regexp_extract_all(text, 'the')) as varchar)), ',') as cited from conversations",
    "x21_answer_json": "select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events",
    "x22_front_matter": "select doc_id, concat_ws('|', 'a', nullif(regexp_extract(text, '([a-z]+)', 1), ''), nullif(regexp_extract(text, '([a-z]+)[^a-z]*$', 1), '')) as tags from documents",
    "x23_source_keys": "select l_orderkey, string_agg(k, ',' order by k) as keys from (select distinct l_orderkey, case l_linenumber % 4 when 0 then 'source_id:' || l_partkey when 1 then 'source_id:p' || l_partkey else 'document_id:' || l_suppkey end as k from lineitem) group by l_orderkey",
    "x21_salvage": """select doc_id, cast(n as int) as n, md5('{' || string_split(text, chr(10))[1] || '" }') as digest from documents, (select unnest([1, 2]) as n)""",
    "x14_sentences": r"""with x as (select doc_id, regexp_replace(regexp_replace(regexp_replace(text, '([。！？])([^”’」』）)\]])', '\1' || chr(1) || '\2', 'g'), '([。！？])([^”’」』）)\]' || chr(1) || '])', '\1' || chr(1) || '\2', 'g'), '([.!?])([ \t\r\n])', '\1' || chr(1) || '\2', 'g') as x from documents),
        s as (select doc_id, unnest([trim(y, ' ' || chr(9) || chr(10) || chr(13)) for y in string_split(x, chr(1))]) as s from x)
        select doc_id, count(*) as sentences, cast(sum(length(s)) as bigint) as chars from s where strlen(s) > 3 group by 1""",
    "x24_injection_phrase": f"select doc_id, [p for p in {_phrases} if contains(lower(x), p)][1] as phrase from (select doc_id, case when doc_id % 7 = 0 then text || ' Act as if' else text end as x from documents)",
    "x25_scrub_context": "select conv_id, turn, md5(regexp_replace(text, '[a-z]{6,}', '', 'g')) as digest from conversations",
    "x28_policies": " union all ".join(_sanitised(p) for p in POLICIES),
    "x28_masking": r"select doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '([A-Za-z0-9])[A-Za-z0-9._%+-]*@', '\1***@', 'g'), '([0-9]{4})[0-9]{5,11}([0-9]{4})', '\1****\2', 'g'), '(\+[0-9]{1,3} ?\(?[0-9]{3}\)? ?)[0-9]{3}(-?[0-9]{4})', '\1***\2', 'g')) as digest from documents",
    "x29_change_ratio": "select p_partkey, round(levenshtein(p_name, p_type || ' ' || p_name) / length(p_type || ' ' || p_name), 6) as ratio from part",
    "x30_failure_words": f"select conv_id, turn, len([w for w in {_failures} if contains(lower(x), w)]) > 0 as failed from (select conv_id, turn, case when turn = 1 then text || ' Error' else text end as x from conversations)",
}
