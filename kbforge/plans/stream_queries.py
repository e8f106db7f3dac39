"""Files and streams: exports, logs and the streaming forms, each against its batch twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.chunking import chunk_documents
from ..operators.redaction import PATTERNS, redact_texts, restore
from ..sources import files
from ..sources.scratch import fresh_dir
from ..streaming import streams as st
from .chunk_queries import CHUNKED
from .fixtures import signals, table


def _stream(spark, d):
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    return st.signal_stream(st.tail(spark, f"{d}/event[s].parquet", schema))  # a pattern, as the table may be one file or a folder


def _scan(spark, d):
    """Documents written as lines of text files and scanned again."""
    out = fresh_dir(spark, "texts")
    table(spark, d, "documents").select(F.to_json(F.struct("doc_id", "text")).alias("value")).write.text(out)
    lines, _ = files.scan_text_lines(spark, out)
    each = lines.select(F.from_json("line", "doc_id long, text string").alias("doc"))
    return each.select(F.col("doc.doc_id").alias("doc_id"), F.md5("doc.text").alias("digest"))


def _log(spark, d):
    """Signals appended to a JSON-lines log, with two kinds of bad lines, and read back."""
    out = fresh_dir(spark, "log")
    ev = signals(spark, d).select(F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("id") % 10 != 0, F.col("baseline")).alias("baseline"), "type", F.col("event_id").cast("string").alias("id"), F.lit("{}").alias("payload"))
    files.append_events(ev, out)
    table(spark, d, "region").select(F.concat(F.lit("{broken "), "r_name").alias("value")).write.mode("append").text(f"{out}/day=2024-01-01")
    return files.read_events(spark, out).groupBy("baseline", "type").agg(F.count("*").alias("n"))


def _csv(spark, d):
    out = fresh_dir(spark, "csv")
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.concat(F.lit('"'), "role", F.lit('", ok')).alias("answer"))
    files.export_csv(rows, out)
    return spark.read.option("header", True).option("escape", '"').schema("conv_id long, turn long, answer string").csv(out)


def _tables(spark, d):
    """Each text as a table of its lines and their first words; lines with bars or without words are prose."""
    cell = lambda x: F.when(x.rlike(r"^[A-Za-z]"), F.concat(F.lit("| "), F.regexp_extract(x, r"^([A-Za-z]+)", 1), F.lit(" | "), F.length(x), F.lit(" |"))).otherwise(F.concat(F.lit("prose "), x))
    text = F.concat(F.lit("| a | b |\n|---|---|\n"), F.array_join(F.transform(F.split("text", "\n"), cell), "\n"))
    rows = files.pipe_tables(table(spark, d, "documents").select("doc_id", text.alias("text")), "doc_id", "text")
    first = rows.where(F.map_contains_key("row", "a") & F.map_contains_key("row", "b"))  # a table that starts after prose has another header
    return first.select("doc_id", "line_no", F.col("row")["a"].alias("a"), F.col("row")["b"].alias("b"))


def _activity(spark, d):
    """Lines that begin with a capital as activity lines, the others as prose."""
    line = lambda x: F.when(x.rlike("^[A-Z]"), F.concat(F.lit("- 2024-01-0"), F.length(x) % 9 + 1, F.lit(" ｜ /"), F.regexp_extract(x, "^([A-Za-z]+)", 1), F.lit(" ｜ "), F.regexp_extract(x, "([a-z]+)[^a-z]*$", 1))).otherwise(x)
    text = F.array_join(F.transform(F.split("text", "\n"), line), "\n")
    return files.activity_lines(table(spark, d, "documents").select("doc_id", text.alias("text")), "doc_id", "text")


def _divergence(spark, d):
    return st.run_once(st.divergence(_stream(spark, d).withColumn("project_id", F.col("user_id") % 20), "error", "click"), "divergence", "complete")


def _alarms(spark, d):
    """A session's steps are its days; events of a kind are calls of a tool, a tenth of their number their arguments."""
    args = F.floor(F.get_json_object("props", "$.k").cast("long") / 100).cast("string")
    calls = _stream(spark, d).select(F.col("user_id").alias("session_id"), F.to_date("at").alias("step"), F.col("event_type").alias("tool"), args.alias("args"), "at")
    return st.run_once(st.repeated_call_alarms(calls, 1), "alarms", "append").groupBy("session_id", "step", "tool", "args").agg(F.max("calls").alias("calls"))


def _ingest(spark, d):
    schema = spark.read.parquet(f"{d}/documents.parquet").schema
    stream = st.tail(spark, f"{d}/document[s].parquet", schema).withColumn("sha", F.sha2("text", 256))
    done = st.ingest_once(stream, "ingest", lambda df: df.select("source", "sha", F.size(F.split("text", "\n")).alias("lines")), ["source", "sha"])
    return done.groupBy("source").agg(F.count("*").alias("versions"), F.sum("lines").alias("lines"))


def _ingest_index(spark, d):
    """Documents ingested as a flow: each version of a source's text once, chunked with children, into a search index; its terms. Several files are four batches at least, so that shuffles on the way hold a part only."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    stream = st.tail(spark, f"{d}/document[s].parquet", docs.schema, files=min(64, -(-len(docs.inputFiles()) // 4) or 1)).withColumn("sha", F.sha2("text", 256))
    number = (F.col("doc_id") * 2**31 + F.col("chunk_no") * 4).cast("long")
    to_chunks = lambda df: chunk_documents(df).select((number + F.col("child_no")).alias("chunk_id"), number.alias("owner"), "content")
    made = st.ingest_index(stream, to_chunks, lambda: {"content": F.regexp_extract_all(F.lower("content"), F.lit("[a-z0-9]+"), F.lit(0))}, ["source", "sha"], fresh_dir(spark, "ingest"), slots=64, owner="owner")
    return made.blocks.groupBy("term").agg(F.sum("n").alias("df"), F.sum("cf").alias("cf"))


def _redacted(spark, d):
    return redact_texts(table(spark, d, "documents").select("doc_id", "text"))


def _restored(spark, d):
    """Redacted texts restored, with the number of placeholders that were filled."""
    return restore(_redacted(spark, d)).select("doc_id", F.md5("restored").alias("digest"), F.size("found").cast("long").alias("filled"))


def _tolerant(spark, d):
    """Placeholders come back in small letters and with blanks."""
    damaged = F.regexp_replace("safe_text", r"\[\$\$_([A-Z]+)_([0-9]+)\]", r"[ \$\$_ $1 _$2 ]")
    damaged = F.when(F.col("doc_id") % 2 == 0, damaged).otherwise(F.regexp_replace("safe_text", r"\[\$\$_EMAIL_", r"[\$\$_Email_"))
    back = restore(_redacted(spark, d).withColumn("safe_text", damaged))
    return back.select("doc_id", F.md5("restored").alias("digest"), F.size("found").cast("long").alias("placeholders")).where("placeholders > 0").select("doc_id", "digest")


QUERIES = {
    "s1_scan": _scan,
    "s3_event_log": _log,
    "s6_csv_export": _csv,
    "s8_pipe_tables": _tables,
    "s9_activity_lines": _activity,
    "st2_daily_counts": lambda spark, d: st.run_once(st.daily_counts(_stream(spark, d)), "daily", "complete"),
    "st3_divergence": _divergence,
    "st4_alarms": _alarms,
    "st5_ingest": _ingest,
    "st5_index": _ingest_index,
    "st7_sessions": lambda spark, d: st.run_once(st.sessions(_stream(spark, d)), "sessions", "complete").select("user_id", F.date_format("started", "yyyy-MM-dd HH:mm:ss").alias("started"), "n"),
    "x26_redaction": lambda spark, d: _redacted(spark, d).select("doc_id", F.md5("safe_text").alias("digest"), F.size("found").cast("long").alias("found")),
    "x27_restore": _restored,
    "x27_tolerant": _tolerant,
}

_REDACTED = "|".join(pattern for _, pattern in PATTERNS)

# Kind by kind: the text split where a pattern matches, and joined again by numbered placeholders. No text of the tables holds chr(1).
_STEPS = ["z0 as (select doc_id, text as t, 0 as n from documents)"]
for _k, (_kind, _pattern) in enumerate(PATTERNS):
    _STEPS.append(f"y{_k} as (select doc_id, string_split(regexp_replace(t, '{_pattern}', chr(1), 'g'), chr(1)) as p, n from z{_k})")
    _STEPS.append(f"z{_k + 1} as (select doc_id, array_to_string([case when i = 1 then x else '[$$_{_kind}_' || (i - 1) || ']' || x end for x, i in p], '') as t, n + len(p) - 1 as n from y{_k})")
_NUMBERED, _LAST = ", ".join(_STEPS), f"z{len(PATTERNS)}"

ORACLES = {
    "s1_scan": "select doc_id, md5(text) as digest from documents",
    "s3_event_log": """select case when event_type in ('error', 'click') then 'quality' when event_type = 'signup' then 'risk' when event_type = 'view' then 'stakeholder' else 'cost' end as baseline,
        case event_type when 'error' then 'defect.created' when 'click' then 'defect.closed' when 'signup' then 'risk.created' when 'view' then 'meeting.held' else 'timesheet.logged' end as type, count(*) as n
        from events where cast(json_extract_string(props, '$.k') as bigint) % 10 <> 0 group by 1, 2""",
    "s6_csv_export": """select conv_id, turn, '"' || role || '", ok' as answer from conversations""",
    "s8_pipe_tables": r"""with l as (select doc_id, unnest(string_split(text, chr(10))) as x, unnest(range(1, len(string_split(text, chr(10))) + 1)) as i from documents), f as (select doc_id, min(i) as stop from l where not regexp_matches(x, '^[A-Za-z]') group by 1)
        select l.doc_id, i + 1 as line_no, regexp_extract(x, '^([A-Za-z]+)', 1) as a, cast(length(x) as varchar) as b from l left join f using (doc_id) where stop is null or i < stop""",
    "s9_activity_lines": r"""select doc_id, '2024-01-0' || (length(x) % 9 + 1) as at, '/' || regexp_extract(x, '^([A-Za-z]+)', 1) as source, regexp_extract(x, '([a-z]+)[^a-z]*$', 1) as summary from (select doc_id, unnest(string_split(text, chr(10))) as x from documents) where regexp_matches(x, '^[A-Z]')""",
    "st2_daily_counts": "select cast(ts as date) as day, event_type, count(*) as n from events group by 1, 2",
    "st3_divergence": """with w as (select cast(ts as date) - k as start, user_id % 20 as project_id, event_type from events, (select unnest([0, 1, 2]) as k)),
        g as (select start, project_id, count(*) filter (where event_type = 'error') as opened, count(*) filter (where event_type = 'click') as closed from w group by 1, 2) select * from g where opened > closed""",
    "st4_alarms": "select user_id as session_id, cast(ts as date) as step, event_type as tool, cast(cast(floor(cast(json_extract_string(props, '$.k') as bigint) / 100) as bigint) as varchar) as args, count(*) as calls from events group by all having count(*) > 1",
    "st5_index": f"""with {CHUNKED.replace("from documents", "from (select min(doc_id) as doc_id, text from documents group by source, text)")}, each as (select doc_id, chunk_no, child_no, term, count(*) as tf
            from (select doc_id, chunk_no, child_no, unnest(regexp_extract_all(lower(content), '[a-z0-9]+')) as term from chunked) group by all)
        select term, count(*) as df, cast(sum(tf) as bigint) as cf from each group by 1""",
    "x27_tolerant": rf"""select doc_id, md5(text) as digest from documents where regexp_matches(text, '{_REDACTED}')""",
    "st5_ingest": "select source, count(*) as versions, cast(sum(n) as bigint) as lines from (select distinct source, sha256(text) as s, len(string_split(text, chr(10))) as n from documents) group by 1",
    "st7_sessions": """with e as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 12 hour then 0 else 1 end as f from events), s as (select *, sum(f) over (partition by user_id order by ts, f desc rows unbounded preceding) as k from e)
        select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as started, count(*) as n from s group by user_id, k""",
    "x26_redaction": f"with {_NUMBERED} select doc_id, md5(t) as digest, n as found from {_LAST}",
    "x27_restore": f"with {_NUMBERED} select doc_id, md5(text) as digest, n as filled from {_LAST} join documents using (doc_id)",
}
