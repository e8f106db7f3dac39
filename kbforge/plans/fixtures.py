"""The roles that the given tables play: chunks, wiki pages, signal events and so on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents that are not blank: (project_id, document_id, chunk_id, line_no, content). A text has fewer than 2^31 lines, so ids are unique."""
    lines = table(spark, sf_dir, "documents").select("source", "doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "content"))
    return lines.where(F.trim("content") != "").select(
        F.col("source").alias("project_id"), F.col("doc_id").alias("document_id"), (F.col("doc_id") * 2**31 + F.col("line_no")).alias("chunk_id"), F.col("line_no").cast("long").alias("line_no"), "content"
    )


CHUNKS = """chunks as (select source as project_id, doc_id as document_id, doc_id * 2147483648 + i - 1 as chunk_id, cast(i - 1 as bigint) as line_no, content
    from (select source, doc_id, unnest(string_split(text, chr(10))) as content, unnest(range(1, len(string_split(text, chr(10))) + 1)) as i from documents)
    where trim(content) <> '')"""


def _slug(key: str) -> Column:
    return F.concat(F.lit("part-"), key)


def _part_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys (a, b) of parts on following lines of an order, repeated if several lines or orders have them. One side is made distinct, where it meets the other."""
    lines = table(spark, sf_dir, "lineitem")
    a = lines.select("l_orderkey", F.col("l_partkey").alias("a"), (F.col("l_linenumber") + 1).alias("n"))
    b = lines.select("l_orderkey", F.col("l_partkey").alias("b"), F.col("l_linenumber").alias("n")).repartition("l_orderkey", "n").distinct()
    return a.join(b, ["l_orderkey", "n"]).where("a <> b").select("a", "b")


def wiki_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed links (source_slug, target_slug) between parts on following lines of an order."""
    return _part_links(spark, sf_dir).distinct().select(_slug("a").alias("source_slug"), _slug("b").alias("target_slug"))


def _projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(project_id, part): the projects of each part, by its key."""
    return table(spark, sf_dir, "part").select((F.col("p_size") % 5).cast("long").alias("project_id"), F.col("p_partkey").alias("part")).distinct()


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What ``wiki_pages`` link, a row each instead of a list a page: distinct (project_id, source_slug, target_slug)."""
    links = _part_links(spark, sf_dir).withColumnRenamed("a", "part").repartition("part").distinct()
    return links.join(_projects(spark, sf_dir), "part").select("project_id", _slug("part").alias("source_slug"), _slug("b").alias("target_slug"))


def page_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources of ``wiki_pages``, a row each instead of a list a page: distinct (project_id, group, slug)."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("part"), "l_orderkey").repartition("part").distinct()
    return lines.join(_projects(spark, sf_dir), "part").select("project_id", F.concat(F.lit("source_id:"), "l_orderkey").alias("group"), _slug("part").alias("slug"))


LINKS = """links as (select distinct 'part-' || a.l_partkey as source_slug, 'part-' || b.l_partkey as target_slug
    from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and b.l_linenumber = a.l_linenumber + 1 and a.l_partkey <> b.l_partkey)"""


def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as pages, without what they link: (project_id, slug, title, page_type, tags)."""
    return table(spark, sf_dir, "part").select(
        (F.col("p_size") % 5).cast("long").alias("project_id"), F.concat(F.lit("part-"), "p_partkey").alias("slug"), F.col("p_name").alias("title"), F.col("p_type").alias("page_type"), F.array("p_brand", "p_type").alias("tags")
    )


def page_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tags of ``page_titles``, a row each: distinct (project_id, group, slug)."""
    return page_titles(spark, sf_dir).select("project_id", F.explode("tags").alias("group"), "slug").distinct()


def wiki_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as pages: (project_id, slug, title, page_type, tags, wikilinks, sources)."""
    links = wiki_links(spark, sf_dir).groupBy(F.col("source_slug").alias("slug")).agg(F.array_sort(F.collect_set("target_slug")).alias("wikilinks"))
    orders = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("part-"), "l_partkey").alias("slug"), F.concat(F.lit("source_id:"), "l_orderkey").alias("key")).groupBy("slug").agg(F.array_sort(F.collect_set("key")).alias("sources"))
    none = F.array().cast("array<string>")
    return page_titles(spark, sf_dir).join(links, "slug", "left").join(orders, "slug", "left").select("project_id", "slug", "title", "page_type", "tags", F.coalesce("wikilinks", none).alias("wikilinks"), F.coalesce("sources", none).alias("sources"))


PAGES = LINKS + """, pages0 as (select cast(p_size % 5 as bigint) as project_id, 'part-' || p_partkey as slug, p_name as title, p_type as page_type, p_brand, p_partkey from part)"""


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Project signals from events: (project_id, ts, baseline, type, id, level, severity, hours)."""
    k = F.get_json_object("props", "$.k").cast("long")
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        "event_id",
        (F.col("user_id") % 20).alias("project_id"),
        "ts",
        F.when(kind.isin("error", "click"), "quality").when(kind == "signup", "risk").when(kind == "view", "stakeholder").otherwise("cost").alias("baseline"),
        F.when(kind == "error", "defect.created").when(kind == "click", "defect.closed").when(kind == "signup", "risk.created").when(kind == "view", "meeting.held").otherwise("timesheet.logged").alias("type"),
        k.alias("id"),
        F.concat(F.lit("P"), k % 4).alias("level"),
        F.when(k % 3 == 0, "高").when(k % 3 == 1, "中").otherwise("低").alias("severity"),
        F.when(kind == "purchase", F.col("value")).alias("hours"),
    )


SIGNALS = """signals as (select event_id, user_id % 20 as project_id, ts,
    case when event_type in ('error', 'click') then 'quality' when event_type = 'signup' then 'risk' when event_type = 'view' then 'stakeholder' else 'cost' end as baseline,
    case event_type when 'error' then 'defect.created' when 'click' then 'defect.closed' when 'signup' then 'risk.created' when 'view' then 'meeting.held' else 'timesheet.logged' end as type,
    k as id, 'P' || (k % 4) as level, case k % 3 when 0 then '高' when 1 then '中' else '低' end as severity, case when event_type = 'purchase' then value end as hours
    from (select *, cast(json_extract_string(props, '$.k') as bigint) as k from events))"""


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Health metrics from events: (project_id, metric_id, indicator_type, value, recorded_at)."""
    kind = F.col("event_type")
    indicator = F.when(kind == "error", "issue_count").when(kind == "click", "attendance").when(kind == "view", "sentiment").when(kind == "signup", "data_delay")
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("project_id"), F.col("event_id").alias("metric_id"), indicator.alias("indicator_type"), F.least("value", F.lit(100.0)).alias("value"), F.col("ts").alias("recorded_at"))
    return rows.where("indicator_type is not null")


METRICS = """metrics as (select user_id % 20 as project_id, event_id as metric_id,
    case event_type when 'error' then 'issue_count' when 'click' then 'attendance' when 'view' then 'sentiment' when 'signup' then 'data_delay' end as indicator_type,
    least(value, 100.0) as value, ts as recorded_at from events where event_type in ('error', 'click', 'view', 'signup'))"""


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool-call audit from events: (call_id, session_id, step, started_at, tool, status, duration_ms, args)."""
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("call_id"), F.col("user_id").alias("session_id"), F.to_date("ts").alias("step"), F.col("ts").alias("started_at"), F.col("event_type").alias("tool"),
        F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status"), F.floor(F.col("value") * 10).alias("duration_ms"), F.col("props").alias("args"), k.alias("k"),
    )


CALLS = """calls as (select event_id as call_id, user_id as session_id, cast(ts as date) as step, ts as started_at, event_type as tool,
    case when event_type = 'error' then 'error' else 'ok' end as status, cast(floor(value * 10) as bigint) as duration_ms, props as args, cast(json_extract_string(props, '$.k') as bigint) as k from events)"""
