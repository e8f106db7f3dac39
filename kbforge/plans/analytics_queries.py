"""Project analytics over events, orders, parts and nations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analytics as a
from ..operators import lookups as lk
from .fixtures import CALLS, CHUNKS, METRICS, SIGNALS, calls, chunks, metrics, signals, table


def _today():
    return F.lit("2024-01-31").cast("date")


def _orders_today():
    return F.lit("2001-08-02").cast("date")


def _phases(spark, d):
    """Nations as phases of regions: seven a project, the first four done."""
    i = F.row_number().over(a.Window.partitionBy("n_regionkey").orderBy("n_nationkey")) - 1
    n = table(spark, d, "nation").select(F.col("n_regionkey").cast("long").alias("project_id"), i.cast("long").alias("phase_index"), "n_nationkey")
    status = F.when(F.col("phase_index") < F.col("project_id"), "completed").when((F.col("phase_index") == F.col("project_id")) & (F.col("project_id") % 2 == 0), "current").otherwise("pending")
    end = F.date_add(F.lit("2024-01-10").cast("date"), (F.col("phase_index") * 10).cast("int"))
    return n.select("project_id", "phase_index", status.alias("status"), (status == "completed").alias("completed"), end.alias("planned_end"))


_PHASES = """phases as (select project_id, phase_index, case when phase_index < project_id then 'completed' when phase_index = project_id and project_id % 2 = 0 then 'current' else 'pending' end as status,
    phase_index < project_id as completed, date '2024-01-10' + cast(phase_index * 10 as int) as planned_end
    from (select cast(n_regionkey as bigint) as project_id, row_number() over (partition by n_regionkey order by n_nationkey) - 1 as phase_index from nation))"""


def _milestones(spark, d):
    return table(spark, d, "orders").select((F.col("o_custkey") % 20).alias("project_id"), F.col("o_orderkey").alias("milestone_id"), F.to_date("o_orderdate").alias("due"), (F.col("o_orderstatus") == "O").alias("pending"))


_MILESTONES = "milestones as (select o_custkey % 20 as project_id, o_orderkey as milestone_id, cast(o_orderdate as date) as due, o_orderstatus = 'O' as pending from orders)"


def _changes(spark, d):
    return table(spark, d, "orders").where("o_orderstatus <> 'P'").select((F.col("o_custkey") % 20).alias("project_id"), F.col("o_orderkey").alias("change_id"), F.to_date("o_orderdate").alias("submitted"), (F.col("o_orderstatus") == "F").alias("approved"), (F.col("o_orderkey") % 5).alias("impact_days"), F.lit(5000).alias("contract_days"))


_CHANGES = "changes as (select o_custkey % 20 as project_id, o_orderkey as change_id, cast(o_orderdate as date) as submitted, o_orderstatus = 'F' as approved, o_orderkey % 5 as impact_days, 5000 as contract_days from orders where o_orderstatus <> 'P')"


def _reports(spark, d):
    """Weekly reports: pages whose number is the project's; the start differs by project."""
    return table(spark, d, "pages").select((F.col("page_id") % 20).alias("project_id"), F.when(F.col("page_id") % 3 == 0, F.date_add(F.lit("2023-10-01").cast("date"), (F.col("page_id") % 90).cast("int"))).alias("report_date"), F.date_add(F.lit("2023-10-01").cast("date"), ((F.col("page_id") % 20) * 5).cast("int")).alias("start_date"))


_REPORTS = "reports as (select page_id % 20 as project_id, case when page_id % 3 = 0 then date '2023-10-01' + cast(page_id % 90 as int) end as report_date, date '2023-10-01' + cast((page_id % 20) * 5 as int) as start_date from pages)"


def _plans(spark, d):
    return signals(spark, d).select("project_id").distinct().withColumns({"contract_days": F.lit(1000.0), "progress": (F.col("project_id") % 4) / F.lit(4.0)})


def _scores(spark, d):
    ev = signals(spark, d)
    parts = [
        a.schedule_score(_phases(spark, d), _today()).drop("spi"), a.cost_score(ev, _plans(spark, d)), a.quality_score(ev), a.risk_score(ev, _today()),
        a.scope_score(_changes(spark, d).where("project_id % 3 <> 0")), a.communication_score(_reports(spark, d), _today()),
    ]
    return a.overall_health(ev.select("project_id").distinct(), parts)


def _anomalies(spark, d):
    ev = signals(spark, d)
    return (
        a.stalled_risks(ev, _today()).unionByName(a.pending_changes(_changes(spark, d), _orders_today(), 30)).unionByName(a.diverging_defects(ev, _today()))
        .unionByName(a.near_milestones(_milestones(spark, d), _orders_today())).unionByName(a.late_reports(_reports(spark, d), _today()))
    )


def _meetings(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    people = F.transform(F.array(k % 7, k % 5), lambda x: F.concat(F.lit("person-"), x))
    return table(spark, d, "events").where("event_type = 'view'").select("event_id", (F.col("user_id") % 20).alias("project_id"), "ts", F.array_distinct(people).alias("participants"))


def _usage(spark, d):
    n = calls(spark, d).groupBy("tool", "status").agg(F.count("*").alias("n"))
    return a.latest(n, ["status"], [F.col("n").desc(), F.col("tool")], 5).drop("nth")


def _closing(spark, d):
    """Parts as requirements, orders as tests, defect events and changes."""
    row = lambda df, kind, project, hits, total: df.select(project.alias("project_id"), F.lit(kind).alias("kind"), hits.cast("long").alias("hits"), total.cast("long").alias("total"))
    part, orders, yes = table(spark, d, "part"), table(spark, d, "orders"), F.lit(True)
    facts = row(part, "requirements", F.col("p_partkey") % 20, F.contains("p_name", F.lit("ring")), yes)
    facts = facts.unionByName(row(orders, "tests", F.col("o_custkey") % 20, F.col("o_orderstatus") == "F", yes))
    facts = facts.unionByName(row(signals(spark, d).where("type like 'defect.%'"), "defects", F.col("project_id"), F.col("type") == "defect.closed", F.col("type") == "defect.created"))
    return a.closing_rates(facts.unionByName(row(_changes(spark, d), "changes", F.col("project_id"), F.col("approved"), yes)))


def _tested(spark, d):
    """Order lines as tests of parts: returned ones failed, accepted ones passed, large orders of the rest are blocked."""
    state = F.when(F.col("l_returnflag") == "R", "fail").when(F.col("l_returnflag") == "A", "pass").when(F.col("l_quantity") > 40, "blocked").otherwise("not-run")
    return table(spark, d, "lineitem").select((F.col("l_partkey") % 20).alias("project_id"), F.col("l_partkey").alias("requirement"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("test_id"), state.alias("status"), "l_linestatus")


def _coverage(spark, d):
    parts = table(spark, d, "part").select((F.col("p_partkey") % 20).alias("project_id"), F.col("p_partkey").alias("requirement"))
    return a.test_coverage(parts, _tested(spark, d))


def _open(spark, d):
    tests = _tested(spark, d)
    return a.open_issues(tests, tests.where("l_linestatus = 'F'")).select("project_id", "test_id", "status")


def _audited(spark, d):
    """Calls with the flags that the audit counts."""
    k = F.col("k")
    return calls(spark, d).withColumns({"truncated": k % 11 == 0, "empty_output": F.when(k % 7 > 0, F.col("duration_ms") < 300), "error_kind": F.when(k % 4 < 3, F.concat(F.lit("kind-"), k % 4))})


def _skills(spark, d):
    """Parts as skills: their first word is the phase, ``hot`` ones are for all phases."""
    first = F.substring_index("p_name", " ", 1)
    return table(spark, d, "part").select(F.concat(F.lit("part-"), "p_partkey").alias("skill"), F.when(first == "hot", "all").otherwise(first).alias("phase"), F.col("p_partkey").alias("listed"), F.col("p_type").alias("category"))


def _recommended(spark, d):
    phases = _skills(spark, d).where("phase <> 'all'").select("phase")
    return a.recommend_for_phases(_skills(spark, d).where("category <> 'SMALL'"), phases)


def _tests(spark, d):
    return table(spark, d, "orders").groupBy((F.col("o_custkey") % 20).alias("project_id")).pivot("o_orderstatus", ["F", "O", "P"]).count().select("project_id", *[F.coalesce(F.col(s), F.lit(0)).alias(n) for s, n in (("F", "passed"), ("O", "open"), ("P", "blocked"))])


def _summary(spark, d):
    """Five counts of each project from five tables, each counted before it is joined."""
    of = lambda name, key, n: table(spark, d, name).select((F.col(key) % n).alias("project_id"))
    counted = {"customers": of("customer", "c_custkey", 25), "documents": of("documents", "doc_id", 20), "pages": of("pages", "page_id", 20), "items": of("part", "p_partkey", 20), "metrics": metrics(spark, d)}
    return lk.with_counts(of("customer", "c_custkey", 25).distinct(), counted)


def _audit(spark, d):
    """Completeness, ranges, orphans and key uniqueness of the given tables as one report."""
    cust, orders, labels = table(spark, d, "customer"), table(spark, d, "orders"), table(spark, d, "labels")
    every = F.lit(True)
    parts = [
        lk.failing_rule(cust, "balance_negative", "warning", F.col("c_acctbal") < 0),
        lk.failing_rule(lk.orphans(orders, cust, "o_custkey", "c_custkey"), "orphan_orders", "critical", every),
        lk.failing_rule(lk.repeated_keys(labels, ["doc_id"]), "label_keys_repeat", "critical", every),
        lk.failing_rule(labels, "label_missing", "info", F.col("quality").isNull() | F.col("toxic").isNull()),
        lk.failing_rule(lk.repeated_keys(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"]), "line_keys_repeat", "warning", every),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


QUERIES = {
    "a1_corpus_statistics": lambda spark, d: a.corpus_statistics(chunks(spark, d)),
    "a2_project_summary": _summary,
    "a3_weighted_health": lambda spark, d: a.weighted_health(metrics(spark, d)),
    "a4_recent_metrics": lambda spark, d: a.latest(metrics(spark, d), ["project_id", "indicator_type"], [F.col("recorded_at").desc(), F.col("metric_id").desc()], 10).select("project_id", "indicator_type", "metric_id", "value"),
    "a5_schedule": lambda spark, d: a.schedule_score(_phases(spark, d), _today()),
    "a6_cost": lambda spark, d: a.cost_score(signals(spark, d), _plans(spark, d)),
    "a7_quality": lambda spark, d: a.quality_score(signals(spark, d)),
    "a8_risk": lambda spark, d: a.risk_score(signals(spark, d), _today()),
    "a9_scope": lambda spark, d: a.scope_score(_changes(spark, d)),
    "a10_communication": lambda spark, d: a.communication_score(_reports(spark, d), _today()),
    "a11_overall": lambda spark, d: _scores(spark, d).select("project_id", "score", "rag", "estimated", *a.SUBSCORES),
    "a12_stalled": lambda spark, d: a.stalled_risks(signals(spark, d), _today()),
    "a13_pending": lambda spark, d: a.pending_changes(_changes(spark, d), _orders_today(), 2, True),
    "a14_diverging": lambda spark, d: a.diverging_defects(signals(spark, d), _today()),
    "a15_near_milestones": lambda spark, d: a.near_milestones(_milestones(spark, d), F.lit("2001-07-25").cast("date")),
    "a16_late_reports": lambda spark, d: a.late_reports(_reports(spark, d), _today()),
    "a17_ranked": lambda spark, d: a.rank_anomalies(_anomalies(spark, d)).select("project_id", "rule", "severity", "subject", "value"),
    "a18_event_index": lambda spark, d: a.event_index(signals(spark, d)),
    "a19_history": lambda spark, d: a.daily_history(metrics(spark, d).select("project_id", F.col("recorded_at").alias("ts"), F.col("value").alias("score")), 20).select("project_id", "days", F.array_join(F.transform("scores", lambda x: x.cast("decimal(10,2)").cast("string")), ",").alias("scores")),
    "a20_contacts": lambda spark, d: a.stakeholder_contact(_meetings(spark, d), _today()),
    "a21_meetings": lambda spark, d: a.recent_meetings(_meetings(spark, d), F.lit("2024-01-28").cast("date")).select("project_id", "event_id"),
    "a23_report_statistics": lambda spark, d: _reports(spark, d).groupBy("project_id").agg(F.count("report_date").alias("reports"), F.max("report_date").alias("last_date")),
    "a24_current_phase": lambda spark, d: a.current_phase(_phases(spark, d)),
    "a25_next_milestone": lambda spark, d: a.next_milestone(_milestones(spark, d), _orders_today()),
    "a26_cards": lambda spark, d: a.score_cards(_scores(spark, d).select("project_id", *a.SUBSCORES)),
    "a27_usage": _usage,
    "a27_recommended": _recommended,
    "a27_by_category": lambda spark, d: _skills(spark, d).groupBy("category").agg(F.count("*").alias("n"), F.min("listed").alias("first")),
    "a28_error_kinds": lambda spark, d: a.error_kinds(_audited(spark, d)),
    "a28_newest_errors": lambda spark, d: a.newest_errors(_audited(spark, d)).select("call_id", "tool", "kind"),
    "a28_call_audit": lambda spark, d: a.audit_calls(_audited(spark, d)).withColumn("last_start", F.date_format("last_start", "yyyy-MM-dd HH:mm:ss")),
    "a30_audit": _audit,
    "a31_progress": lambda spark, d: a.phase_progress(_phases(spark, d)),
    "a31_recent_outputs": lambda spark, d: a.latest(table(spark, d, "orders").withColumn("project_id", F.col("o_custkey") % 20), ["project_id"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()], 5).select("project_id", "o_orderkey"),
    "a32_plan_validation": lambda spark, d: table(spark, d, "orders").select("o_orderkey", (F.date_add(F.to_date("o_orderdate"), (F.col("o_orderkey") % 7 - 3).cast("int")) < F.to_date("o_orderdate")).alias("rejected")),
    "a33_closing_rates": _closing,
    "a34_test_statistics": _tests,
    "a34_coverage": _coverage,
    "a34_open_issues": _open,
    "a35_pareto": lambda spark, d: a.pareto(calls(spark, d), "tool"),
}

_T, _OT = "date '2024-01-31'", "date '2001-08-02'"
_SCORES = f"""{SIGNALS}, {_PHASES}, {_CHANGES}, {_REPORTS}, proj as (select distinct project_id from signals),
    s1 as (select project_id, cast(trunc(greatest(least(100 - abs(1 - spi) * 100, 100), 0)) as bigint) as schedule, round(spi, 2) as spi from (select project_id, sum(completed::int) / greatest(sum((planned_end <= {_T})::int), 1) as spi from phases group by 1)),
    s2 as (select project_id, cast(trunc(greatest(least(100 - round(greatest(case when coalesce(h, 0) > 0 then h / 8 else p * 1000 end / 1000 - p, 0) * 200, 6), 100), 0)) as bigint) as cost from (select project_id, project_id % 4 / 4.0::double as p, (select sum(hours) from signals s where s.project_id = proj.project_id) as h from proj)),
    act as (select * from signals c where type = 'defect.created' and not exists (select 1 from signals d where d.type = 'defect.closed' and d.project_id = c.project_id and d.id = c.id)),
    s3 as (select project_id, cast(100 - least(coalesce((select sum(case level when 'P0' then 20 when 'P1' then 10 when 'P2' then 3 else 1 end) from act where act.project_id = q.project_id), 0), 100) as bigint) as quality from (select distinct project_id from signals where type like 'defect.%') q),
    s4 as (select project_id, cast(100 - least(sum(case severity when '高' then 15 when '中' then 5 else 0 end + greatest(date_diff('day', cast(ts as date), {_T}), 0)), 100) as bigint) as risk from signals where type = 'risk.created' group by 1),
    s5 as (select project_id, cast(trunc(greatest(least(100 - round(sum(case when approved then impact_days else 0 end) / 5000 * 300, 6), 100), 0)) as bigint) as scope from changes group by 1),
    s6 as (select project_id, cast(trunc(least(count(report_date) / greatest(floor(date_diff('day', min(start_date), {_T}) / 7), 1), 1.0) * 100) as bigint) as comm from reports group by 1),
    allscores as (select project_id, coalesce(schedule, 70) as schedule, coalesce(cost, 70) as cost, coalesce(quality, 80) as quality, coalesce(risk, 80) as risk, coalesce(case when project_id % 3 <> 0 then scope end, 90) as scope, coalesce(comm, 70) as comm,
        array_to_string(list_sort([x for x in [case when schedule is null then 'schedule' end, case when cost is null then 'cost' end, case when quality is null then 'quality' end, case when risk is null then 'risk' end, case when scope is null or project_id % 3 = 0 then 'scope' end, case when comm is null then 'comm' end] if x is not null]), ',') as estimated
        from proj left join s1 using (project_id) left join s2 using (project_id) left join s3 using (project_id) left join s4 using (project_id) left join s5 using (project_id) left join s6 using (project_id)),
    overall as (select *, (25 * schedule + 20 * cost + 20 * quality + 20 * risk + 10 * scope + 5 * comm) // 100 as score from allscores)"""
_ANOMALIES = f"""{SIGNALS}, {_CHANGES}, {_MILESTONES}, {_REPORTS}, last_risk as (select project_id, id, date_diff('day', cast(max(ts) as date), {_T}) as age from signals where baseline = 'risk' group by 1, 2),
    r1 as (select project_id, 'R-STALL' as rule, 'high' as severity, cast(id as varchar) as subject, age as value from last_risk where age > 3),
    r2 as (select project_id, 'C-PENDING' as rule, 'high' as severity, cast(change_id as varchar) as subject, date_diff('day', submitted, {_OT}) as value, approved from changes where date_diff('day', submitted, {_OT}) > 2),
    r3 as (select project_id, 'D-DIVERGE' as rule, 'high' as severity, '' as subject, cast(sum((type = 'defect.created')::int) - sum((type = 'defect.closed')::int) as bigint) as value from signals where date_diff('day', cast(ts as date), {_T}) between 0 and 3 group by 1 having sum((type = 'defect.created')::int) > sum((type = 'defect.closed')::int)),
    r4 as (select project_id, 'M-NEAR' as rule, 'medium' as severity, cast(milestone_id as varchar) as subject, date_diff('day', {_OT}, due) as value from milestones where pending and date_diff('day', {_OT}, due) between 0 and 7),
    r5 as (select project_id, 'W-LATE' as rule, 'medium' as severity, '' as subject, cast(weeks - n as bigint) as value from (select project_id, count(report_date) as n, greatest(floor(date_diff('day', min(start_date), {_T}) / 7), 1) as weeks from reports group by 1) where weeks > n)"""
_TESTED = """tested as (select l_partkey % 20 as project_id, l_partkey as requirement, l_orderkey || '-' || l_linenumber as test_id, l_linestatus,
    case when l_returnflag = 'R' then 'fail' when l_returnflag = 'A' then 'pass' when l_quantity > 40 then 'blocked' else 'not-run' end as status from lineitem)"""
_MEET = "meet as (select event_id, user_id % 20 as project_id, ts, cast(json_extract_string(props, '$.k') as bigint) as k from events where event_type = 'view')"

ORACLES = {
    "a1_corpus_statistics": f"with {CHUNKS}, per as (select project_id, document_id, count(*) as chunks from chunks group by 1, 2) select project_id, count(*) as documents, cast(sum(chunks) as bigint) as chunks from per group by rollup (project_id)",
    "a2_project_summary": f"""with {METRICS}, c as (select c_custkey % 25 as project_id, count(*) as customers from customer group by 1) select project_id, customers,
        (select count(*) from documents where doc_id % 20 = project_id) as documents, (select count(*) from pages where page_id % 20 = project_id) as pages, (select count(*) from part where p_partkey % 20 = project_id) as items, (select count(*) from metrics m where m.project_id = c.project_id) as metrics from c""",
    "a3_weighted_health": f"""with {METRICS}, last as (select *, case indicator_type when 'attendance' then 0.30 when 'data_delay' then 0.25 when 'issue_count' then 0.25 else 0.20 end as w from (select *, row_number() over (partition by project_id, indicator_type order by recorded_at desc, metric_id desc) as r from metrics) where r = 1),
        g as (select project_id, sum(value * cast(w as double)) / sum(cast(w as double)) as raw, count(*) filter (where value >= 50) as alerts, count(*) as present from last group by 1)
        select project_id, round(raw, 1) as score, case when raw >= 70 then 'critical' when raw >= 50 then 'high' when raw >= 30 then 'medium' else 'low' end as level, alerts, round(present / 4, 3) as completeness, case when alerts >= 2 then 'several' when alerts >= 1 then 'some' when present < 4 then 'partial' else 'healthy' end as trend from g""",
    "a4_recent_metrics": f"with {METRICS} select project_id, indicator_type, metric_id, value from (select *, row_number() over (partition by project_id, indicator_type order by recorded_at desc, metric_id desc) as r from metrics) where r <= 10",
    "a5_schedule": f"with {_SCORES} select * from s1",
    "a6_cost": f"with {_SCORES} select * from s2",
    "a7_quality": f"with {_SCORES} select * from s3",
    "a8_risk": f"with {_SCORES} select * from s4",
    "a9_scope": f"with {_SCORES} select * from s5",
    "a10_communication": f"with {_SCORES} select * from s6",
    "a11_overall": f"with {_SCORES} select project_id, score, case when score >= 80 then 'green' when score >= 60 then 'yellow' else 'red' end as rag, estimated, schedule, cost, quality, risk, scope, comm from overall",
    "a12_stalled": f"with {_ANOMALIES} select * from r1",
    "a13_pending": f"with {_ANOMALIES} select project_id, rule, severity, subject, value from r2 where not approved",
    "a14_diverging": f"with {_ANOMALIES} select * from r3",
    "a15_near_milestones": f"with {_MILESTONES} select project_id, 'M-NEAR' as rule, 'medium' as severity, cast(milestone_id as varchar) as subject, date_diff('day', date '2001-07-25', due) as value from milestones where pending and date_diff('day', date '2001-07-25', due) between 0 and 7",
    "a16_late_reports": f"with {_ANOMALIES} select * from r5",
    "a17_ranked": f"""with {_ANOMALIES}, al as (select * from r1 union all select project_id, rule, severity, subject, value from r2 where value > 30 union all select * from r3 union all select * from r4 union all select * from r5)
        select project_id, rule, severity, subject, value from (select *, row_number() over (partition by project_id order by case severity when 'high' then 0 else 1 end, rule, subject) as r from al) where r <= 3""",
    "a18_event_index": f"with {SIGNALS} select baseline, type, count(*) as n from signals group by cube (baseline, type)",
    "a19_history": f"""with {METRICS}, daily as (select project_id, cast(recorded_at as date) as day, value, row_number() over (partition by project_id, cast(recorded_at as date) order by recorded_at desc, value desc) as r from metrics),
        kept as (select *, row_number() over (partition by project_id order by day desc) as nth from daily where r = 1)
        select project_id, count(*) as days, string_agg(case when nth <= 8 then cast(cast(value as decimal(10,2)) as varchar) end, ',' order by day) as scores from kept where nth <= 20 group by 1""",
    "a20_contacts": f"with {_MEET}, p as (select project_id, ts, 'person-' || k % 7 as person from meet union all select project_id, ts, 'person-' || k % 5 from meet) select project_id, person, cast(max(ts) as date) as last_contact, date_diff('day', cast(max(ts) as date), {_T}) as stale_days from p group by 1, 2",
    "a21_meetings": f"with {_MEET} select project_id, event_id from (select *, row_number() over (partition by project_id order by ts desc, event_id) as r from meet where cast(ts as date) between date '2024-01-22' and date '2024-01-28') where r <= 5",
    "a23_report_statistics": f"with {_REPORTS} select project_id, count(report_date) as reports, max(report_date) as last_date from reports group by 1",
    "a24_current_phase": f"with {_PHASES} select project_id, cast(coalesce(min(case when status = 'current' then phase_index end), greatest(min(case when status = 'pending' then phase_index end) - 1, 0), max(phase_index)) as bigint) as phase_index from phases group by 1",
    "a25_next_milestone": f"""with {_MILESTONES}, n as (select *, date_diff('day', {_OT}, due) as away, row_number() over (partition by project_id order by abs(date_diff('day', {_OT}, due)), milestone_id) as r from milestones where pending)
        select project_id, milestone_id, case when away < 0 then 'overdue ' || -away when away = 0 then 'today' else 'in ' || away end as label from n where r = 1""",
    "a26_cards": f"with {_SCORES} select project_id, card, value, case when value >= 80 then 'green' when value >= 60 then 'yellow' else 'red' end as rag from (unpivot (select project_id, schedule, cost, quality, risk, scope, comm from overall) on schedule, cost, quality, risk, scope, comm into name card value value)",
    "a27_usage": f"with {CALLS}, n as (select tool, status, count(*) as n from calls group by 1, 2) select tool, status, n from (select *, row_number() over (partition by status order by n desc, tool) as r from n) where r <= 5",
    "a28_call_audit": f"with {CALLS} select tool, count(*) as calls, count(*) filter (where status = 'ok') as ok, count(*) filter (where status = 'error') as errors, count(*) filter (where k % 11 = 0) as truncated, count(*) filter (where k % 7 > 0 and duration_ms < 300) as empty, cast(floor(sum(duration_ms) / count(*)) as bigint) as mean_ms, max(duration_ms) as max_ms, strftime(max(started_at), '%Y-%m-%d %H:%M:%S') as last_start from calls group by rollup (tool)",
    "a30_audit": """select 'balance_negative' as rule, 'warning' as severity, count(*) filter (where c_acctbal < 0) as failed from customer
        union all select 'orphan_orders', 'critical', count(*) from orders where o_custkey not in (select c_custkey from customer)
        union all select 'label_keys_repeat', 'critical', count(*) from (select doc_id from labels group by 1 having count(*) > 1)
        union all select 'label_missing', 'info', count(*) filter (where quality is null or toxic is null) from labels
        union all select 'line_keys_repeat', 'warning', count(*) from (select 1 from lineitem group by l_orderkey, l_linenumber having count(*) > 1)""",
    "a31_progress": f"with {_PHASES} select project_id, count(*) filter (where completed) as done, cast(round(count(*) filter (where completed) * 100 / count(*)) as bigint) as percent from phases group by 1",
    "a32_plan_validation": "select o_orderkey, o_orderkey % 7 - 3 < 0 as rejected from orders",
    "a27_recommended": """with s as (select 'part-' || p_partkey as skill, case when string_split(p_name, ' ')[1] = 'hot' then 'all' else string_split(p_name, ' ')[1] end as phase, p_partkey as listed, p_type from part),
        p as (select distinct phase from s where phase <> 'all'), c as (select p.phase, skill, 0 as g, listed from p join s using (phase) where p_type <> 'SMALL' union all select p.phase, skill, 1, listed from p, s where s.phase = 'all' and p_type <> 'SMALL')
        select phase, skill, place from (select *, row_number() over (partition by phase order by g, listed) as place from c) where place <= 6""",
    "a27_by_category": "select p_type as category, count(*) as n, min(p_partkey) as first from part group by 1",
    "a28_error_kinds": f"with {CALLS} select case when k % 4 < 3 then 'kind-' || k % 4 else 'unknown' end as kind, count(*) as n from calls where status = 'error' group by 1",
    "a28_newest_errors": f"with {CALLS} select call_id, tool, case when k % 4 < 3 then 'kind-' || k % 4 else 'unknown' end as kind from calls where status = 'error' order by started_at desc, call_id desc limit 5",
    "a31_recent_outputs": "select project_id, o_orderkey from (select o_custkey % 20 as project_id, o_orderkey, row_number() over (partition by o_custkey % 20 order by o_orderdate desc, o_orderkey desc) as r from orders) where r <= 5",
    "a33_closing_rates": f"""with {SIGNALS}, {_CHANGES}, f as (select p_partkey % 20 as project_id, 'r' as kind, contains(p_name, 'ring')::int as hits, 1 as total from part union all select o_custkey % 20, 't', (o_orderstatus = 'F')::int, 1 from orders
            union all select project_id, 'd', (type = 'defect.closed')::int, (type = 'defect.created')::int from signals where type like 'defect.%' union all select project_id, 'c', approved::int, 1 from changes)
        select project_id, round(sum(hits) filter (where kind = 'r') / nullif(sum(total) filter (where kind = 'r'), 0), 6) as requirements, round(sum(hits) filter (where kind = 't') / nullif(sum(total) filter (where kind = 't'), 0), 6) as tests,
            round(sum(hits) filter (where kind = 'd') / nullif(sum(total) filter (where kind = 'd'), 0), 6) as defects, round(sum(hits) filter (where kind = 'c') / nullif(sum(total) filter (where kind = 'c'), 0), 6) as changes from f group by 1""",
    "a34_coverage": f"""with {_TESTED}, ran as (select distinct requirement from tested where status <> 'not-run'),
        s as (select p_partkey % 20 as project_id, round(count(requirement) / count(*), 6) as coverage from part left join ran on requirement = p_partkey group by 1),
        c as (select project_id, count(*) filter (where status = 'not-run') as not_run, count(*) filter (where status = 'pass') as passed, count(*) filter (where status = 'fail') as failed, count(*) filter (where status = 'blocked') as blocked from tested group by 1)
        select project_id, coverage, coalesce(not_run, 0) as not_run, coalesce(passed, 0) as passed, coalesce(failed, 0) as failed, coalesce(blocked, 0) as blocked from s left join c using (project_id)""",
    "a34_open_issues": f"with {_TESTED} select project_id, test_id, status from tested where status in ('fail', 'blocked') and test_id not in (select test_id from tested where l_linestatus = 'F')",
    "a34_test_statistics": "select o_custkey % 20 as project_id, count(*) filter (where o_orderstatus = 'F') as passed, count(*) filter (where o_orderstatus = 'O') as open, count(*) filter (where o_orderstatus = 'P') as blocked from orders group by 1",
    "a35_pareto": f"""with {CALLS}, n as (select tool, count(*) as n from calls group by 1), r as (select *, sum(n) over (order by n desc, tool) as upto, sum(n) over () as total from n)
        select tool, n, round(upto / total, 6) as share, (upto - n) / total < 0.8 as vital from r""",
}
