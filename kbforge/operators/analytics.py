"""Project analytics: health scores, anomaly rules, trends, coverage and audits, for all projects at once.

``today`` is always an argument. Scores that the rules truncate are truncated towards zero.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored

#: Weights, levels and defaults of the scores.
INDICATORS = {"attendance": 0.30, "data_delay": 0.25, "issue_count": 0.25, "sentiment": 0.20}
SUBSCORES = {"schedule": 0.25, "cost": 0.20, "quality": 0.20, "risk": 0.20, "scope": 0.10, "comm": 0.05}
DEFAULTS = {"schedule": 70, "cost": 70, "quality": 80, "risk": 80, "scope": 90, "comm": 70}
DEFECT_WEIGHTS = {"P0": 20, "P1": 10, "P2": 3, "P3": 1}


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key in ``order``, with ``nth``."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("nth") <= n)


def running_total(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], value: str, out: str) -> DataFrame:
    """``rows`` with ``out``: the sum of ``value`` over the rows of its key before it in ``order``, for keys of any size.

    Rows are range-partitioned by ``order`` and written; the sums of the ranges are accumulated, and
    only inside a range does a window run.
    """
    dealt = stored(rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")
    sums = dealt.groupBy(*keys, "__range").agg(F.sum(value).alias("__sum"))
    before = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__range").alias("__of"), F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__start"))
    same = F.col("__range") == F.col("__of")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    inside = Window.partitionBy(*keys, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    found = dealt.join(starts, same).withColumn(out, F.col("__start") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return found.drop("__range", "__of", "__start", *[f"__{k}" for k in keys])


def days(later: Column, earlier: Column) -> Column:
    return F.datediff(later, earlier)


def clamp(x: Column, low: float = 0, high: float = 100) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def corpus_statistics(chunks: DataFrame) -> DataFrame:
    """Documents and chunks of each project, and of all (project_id null)."""
    per = chunks.groupBy("project_id", "document_id").agg(F.count("*").alias("chunks"))
    return per.rollup("project_id").agg(F.count("*").alias("documents"), F.sum("chunks").alias("chunks"))


def weighted_health(metrics: DataFrame) -> DataFrame:
    """Per project: the weighted mean of the latest value of each indicator present, its level, alerts, completeness and trend."""
    last = latest(metrics, ["project_id", "indicator_type"], [F.col("recorded_at").desc(), F.col("metric_id").desc()])
    weight = F.lit(None).cast("double")
    for name, w in INDICATORS.items():
        weight = F.when(F.col("indicator_type") == name, w).otherwise(weight)
    known = last.withColumn("w", weight).where("w is not null").groupBy("project_id").agg(
        F.sum(F.col("value") * F.col("w")).alias("s"), F.sum("w").alias("total"), F.count_if(F.col("value") >= 50).alias("alerts"), F.count("*").alias("present")
    )
    raw = F.col("s") / F.col("total")
    level = F.when(raw >= 70, "critical").when(raw >= 50, "high").when(raw >= 30, "medium").otherwise("low")
    trend = F.when(F.col("alerts") >= 2, "several").when(F.col("alerts") >= 1, "some").when(F.col("present") < len(INDICATORS), "partial").otherwise("healthy")
    return known.select("project_id", F.round(raw, 1).alias("score"), level.alias("level"), "alerts", F.round(F.col("present") / len(INDICATORS), 3).alias("completeness"), trend.alias("trend"))


def schedule_score(phases: DataFrame, today: Column) -> DataFrame:
    """(project_id, schedule) from (project_id, completed, planned_end): phases done over phases planned by ``today``."""
    done, planned = F.count_if("completed"), F.count_if(F.col("planned_end") <= today)
    spi = done / F.greatest(planned, F.lit(1))
    return phases.groupBy("project_id").agg(clamp(100 - F.abs(1 - spi) * 100).cast("int").cast("long").alias("schedule"), F.round(spi, 2).alias("spi"))


def cost_score(events: DataFrame, plans: DataFrame) -> DataFrame:
    """(project_id, cost) from logged hours and (project_id, contract_days, progress)."""
    hours = events.where("type = 'timesheet.logged'").groupBy("project_id").agg(F.sum("hours").alias("hours"))
    used = F.when(F.coalesce("hours", F.lit(0.0)) > 0, F.col("hours") / 8).otherwise(F.col("progress") * F.col("contract_days"))
    over = F.greatest(used / F.col("contract_days") - F.col("progress"), F.lit(0.0))
    return plans.join(hours, "project_id", "left").select("project_id", clamp(100 - F.round(over * 200, 6)).cast("int").cast("long").alias("cost"))


def active_defects(events: DataFrame) -> DataFrame:
    """Created defects whose id has not been closed in the project."""
    closed = events.where("type = 'defect.closed'").select("project_id", "id").distinct()
    return events.where("type = 'defect.created'").join(closed, ["project_id", "id"], "left_anti")


def quality_score(events: DataFrame) -> DataFrame:
    """(project_id, quality) for projects with any defect event."""
    points = F.lit(0)
    for level, p in DEFECT_WEIGHTS.items():
        points = F.when(F.col("level") == level, p).otherwise(points)
    lost = active_defects(events).groupBy("project_id").agg(F.sum(points).alias("lost"))
    projects = events.where("type like 'defect.%'").select("project_id").distinct()
    return projects.join(lost, "project_id", "left").select("project_id", (100 - F.least(F.coalesce("lost", F.lit(0)), F.lit(100))).cast("long").alias("quality"))


def risk_score(events: DataFrame, today: Column) -> DataFrame:
    """(project_id, risk): 15 a high and 5 a medium risk, and a point a stalled day."""
    stalled = F.greatest(days(today, F.to_date("ts")), F.lit(0))
    lost = F.sum(F.when(F.col("severity") == "高", 15).when(F.col("severity") == "中", 5).otherwise(0) + stalled)
    return events.where("type = 'risk.created'").groupBy("project_id").agg((100 - F.least(lost, F.lit(100))).cast("long").alias("risk"))


def scope_score(changes: DataFrame) -> DataFrame:
    """(project_id, scope) from (project_id, approved, impact_days, contract_days)."""
    used = F.sum(F.when(F.col("approved"), F.col("impact_days")).otherwise(0)) / F.max("contract_days")
    return changes.groupBy("project_id").agg(clamp(100 - F.round(used * 300, 6)).cast("int").cast("long").alias("scope"))


def communication_score(reports: DataFrame, today: Column) -> DataFrame:
    """(project_id, comm) from (project_id, report_date, start_date): reports over the weeks since the start."""
    weeks = F.greatest(F.floor(days(today, F.min("start_date")) / 7), F.lit(1))
    return reports.groupBy("project_id").agg((F.least(F.count("report_date") / weeks, F.lit(1.0)) * 100).cast("int").cast("long").alias("comm"))


def overall_health(projects: DataFrame, scores: Sequence[DataFrame]) -> DataFrame:
    """All sub-scores (defaults where missing), the weighted total, its colour, and the names of those estimated."""
    found = projects
    for part in scores:
        found = found.join(part, "project_id", "left")
    missing = F.array_sort(F.filter(F.array(*[F.when(F.col(n).isNull(), n) for n in SUBSCORES]), lambda x: x.isNotNull()))
    found = found.withColumn("estimated", F.array_join(missing, ","))
    for n in SUBSCORES:
        found = found.withColumn(n, F.coalesce(n, F.lit(DEFAULTS[n])).cast("long"))
    total = sum((F.col(n) * int(w * 100) for n, w in SUBSCORES.items()), F.lit(0))
    found = found.withColumn("score", F.floor(total / 100))
    return found.withColumn("rag", F.when(F.col("score") >= 80, "green").when(F.col("score") >= 60, "yellow").otherwise("red"))


def stalled_risks(events: DataFrame, today: Column, most: int = 3) -> DataFrame:
    """Risks that nothing has touched for more than ``most`` days."""
    last = events.where("baseline = 'risk'").groupBy("project_id", "id").agg(F.max("ts").alias("ts"))
    age = days(today, F.to_date("ts"))
    return last.where(age > most).select("project_id", F.lit("R-STALL").alias("rule"), F.lit("high").alias("severity"), F.col("id").cast("string").alias("subject"), age.cast("long").alias("value"))


def pending_changes(changes: DataFrame, today: Column, most: int = 2, exclude_approved: bool = False) -> DataFrame:
    """Changes (project_id, change_id, submitted, approved) pending for more than ``most`` days."""
    rows = changes.where(~F.col("approved")) if exclude_approved else changes
    age = days(today, F.col("submitted"))
    return rows.where(age > most).select("project_id", F.lit("C-PENDING").alias("rule"), F.lit("high").alias("severity"), F.col("change_id").cast("string").alias("subject"), age.cast("long").alias("value"))


def diverging_defects(events: DataFrame, today: Column, window: int = 3) -> DataFrame:
    """Projects with more defects created than closed in the last ``window`` days."""
    recent = events.where(days(today, F.to_date("ts")).between(0, window))
    counts = recent.groupBy("project_id").agg(F.count_if(F.col("type") == "defect.created").alias("c"), F.count_if(F.col("type") == "defect.closed").alias("d"))
    return counts.where("c > d").select("project_id", F.lit("D-DIVERGE").alias("rule"), F.lit("high").alias("severity"), F.lit("").alias("subject"), (F.col("c") - F.col("d")).alias("value"))


def near_milestones(milestones: DataFrame, today: Column, ahead: int = 7) -> DataFrame:
    """Pending milestones (project_id, milestone_id, due, pending) due within ``ahead`` days."""
    left = days(F.col("due"), today)
    return milestones.where(F.col("pending") & left.between(0, ahead)).select("project_id", F.lit("M-NEAR").alias("rule"), F.lit("medium").alias("severity"), F.col("milestone_id").cast("string").alias("subject"), left.cast("long").alias("value"))


def late_reports(reports: DataFrame, today: Column) -> DataFrame:
    """Projects with fewer weekly reports than full weeks since the start (at least one)."""
    weeks = F.greatest(F.floor(days(today, F.min("start_date")) / 7), F.lit(1))
    counts = reports.groupBy("project_id").agg(F.count("report_date").alias("n"), weeks.alias("weeks"))
    return counts.where("weeks > n").select("project_id", F.lit("W-LATE").alias("rule"), F.lit("medium").alias("severity"), F.lit("").alias("subject"), (F.col("weeks") - F.col("n")).alias("value"))


def rank_anomalies(anomalies: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` most severe anomalies of each project; ties by rule and subject."""
    severity = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)
    return latest(anomalies, ["project_id"], [severity, F.col("rule"), F.col("subject")], n)


def event_index(events: DataFrame) -> DataFrame:
    """Event counts by baseline, by type, by both and overall (nulls stand for all)."""
    return events.cube("baseline", "type").agg(F.count("*").alias("n"))


def daily_history(snapshots: DataFrame, keep: int = 120, recent: int = 8) -> DataFrame:
    """(project_id, days, scores): one score a day (the last wins) of (project_id, ts, score), newest ``keep`` days, last ``recent`` as an array."""
    daily = latest(snapshots.withColumn("day", F.to_date("ts")), ["project_id", "day"], [F.col("ts").desc(), F.col("score").desc()]).drop("nth")
    kept = latest(daily, ["project_id"], [F.col("day").desc()], keep)
    return kept.groupBy("project_id").agg(F.count("*").alias("days"), F.transform(F.array_sort(F.collect_list(F.when(F.col("nth") <= recent, F.struct("day", "score")))), lambda x: x["score"]).alias("scores"))


def stakeholder_contact(meetings: DataFrame, today: Column) -> DataFrame:
    """(project_id, person, last_contact, stale_days) from (project_id, ts, participants)."""
    seen = meetings.select("project_id", "ts", F.explode("participants").alias("person")).groupBy("project_id", "person").agg(F.to_date(F.max("ts")).alias("last_contact"))
    return seen.withColumn("stale_days", days(today, F.col("last_contact")).cast("long"))


def recent_meetings(meetings: DataFrame, today: Column, n: int = 5) -> DataFrame:
    """Meetings since Monday, the newest ``n`` of each project."""
    return latest(meetings.where((F.to_date("ts") >= F.date_trunc("week", today).cast("date")) & (F.to_date("ts") <= today)), ["project_id"], [F.col("ts").desc(), F.col("event_id")], n)


def current_phase(phases: DataFrame) -> DataFrame:
    """Per project the first phase in progress, else the one before the first not started, else the last."""
    at = lambda s: F.min(F.when(F.col("status") == s, F.col("phase_index")))
    before = F.greatest(at("pending") - 1, F.lit(0))
    return phases.groupBy("project_id").agg(F.coalesce(at("current"), before, F.max("phase_index")).cast("long").alias("phase_index"))


def next_milestone(milestones: DataFrame, today: Column) -> DataFrame:
    """Per project the nearest pending milestone, by distance in days, with its label."""
    distance = days(F.col("due"), today)
    near = milestones.where("pending").groupBy("project_id").agg(F.min(F.struct(F.abs(distance).alias("far"), F.col("milestone_id").alias("milestone_id"), distance.alias("left"))).alias("m"))
    label = F.when(F.col("m.left") < 0, F.concat(F.lit("overdue "), -F.col("m.left"))).when(F.col("m.left") == 0, "today").otherwise(F.concat(F.lit("in "), F.col("m.left")))
    return near.select("project_id", F.col("m.milestone_id").alias("milestone_id"), label.alias("label"))


def score_cards(scores: DataFrame) -> DataFrame:
    """The sub-scores in long form with their colour."""
    long = scores.unpivot("project_id", list(SUBSCORES), "card", "value")
    return long.withColumn("rag", F.when(F.col("value") >= 80, "green").when(F.col("value") >= 60, "yellow").otherwise("red"))


def audit_calls(calls: DataFrame) -> DataFrame:
    """Per tool and overall (tool null): calls, ok, errors, truncated, empty, integer mean and maximum duration, last start.

    ``calls`` has (tool, status, truncated, empty_output, duration_ms, started_at); null flags are false.
    """
    return calls.rollup("tool").agg(
        F.count("*").alias("calls"), F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") != "ok").alias("errors"),
        F.count_if("truncated").alias("truncated"), F.count_if("empty_output").alias("empty"),
        F.floor(F.sum("duration_ms") / F.count("*")).alias("mean_ms"), F.max("duration_ms").alias("max_ms"), F.max("started_at").alias("last_start"),
    )


def error_kinds(calls: DataFrame) -> DataFrame:
    """(kind, n) of failed calls; those without a kind are ``unknown``."""
    return calls.where("status <> 'ok'").groupBy(F.coalesce("error_kind", F.lit("unknown")).alias("kind")).agg(F.count("*").alias("n"))


def newest_errors(calls: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` newest failed calls over all tools (a report)."""
    failed = calls.where("status <> 'ok'").withColumn("kind", F.coalesce("error_kind", F.lit("unknown")))
    return failed.orderBy(F.col("started_at").desc(), F.col("call_id").desc()).limit(n)


def recommend_for_phases(skills: DataFrame, phases: DataFrame, most: int = 6, generic: str = "all") -> DataFrame:
    """(phase, skill, place): for each of ``phases`` its own skills first, then generic ones, ``most`` in all, each group in the order of ``listed``.

    ``skills`` is (skill, phase, listed), a row for each phase of a skill.
    """
    asked = phases.select("phase").distinct()
    own = latest(skills.join(asked, "phase", "left_semi"), ["phase"], [F.col("listed")], most).select("phase", "skill", F.lit(0).alias("group"), "listed")
    common = latest(skills.where(F.col("phase") == generic), ["phase"], [F.col("listed")], 2 * most)  # some may be a phase's own
    common = asked.select("phase", F.lit(generic).alias("of")).join(common.select(F.col("phase").alias("of"), "skill", "listed"), "of")
    extra = common.join(own.select("phase", "skill"), ["phase", "skill"], "left_anti").select("phase", "skill", F.lit(1).alias("group"), "listed")
    return latest(own.unionByName(extra), ["phase"], [F.col("group"), F.col("listed")], most).select("phase", "skill", F.col("nth").cast("long").alias("place"))


def phase_progress(phases: DataFrame) -> DataFrame:
    """(project_id, done, percent): completed phases and their rounded share."""
    done = F.count_if("completed")
    return phases.groupBy("project_id").agg(done.alias("done"), F.round(done * 100 / F.count("*")).cast("long").alias("percent"))


def closing_rates(facts: DataFrame, kinds: Sequence[str] = ("requirements", "tests", "defects", "changes")) -> DataFrame:
    """(project_id, a rate for each kind) from (project_id, kind, hits, total): what is covered, passed, closed or completed of all; null without any."""
    rate = lambda k: F.round(F.sum(F.when(F.col("kind") == k, F.col("hits"))) / F.nullif(F.sum(F.when(F.col("kind") == k, F.col("total"))), F.lit(0)), 6).alias(k)
    return facts.groupBy("project_id").agg(*map(rate, kinds))


def test_coverage(requirements: DataFrame, tests: DataFrame) -> DataFrame:
    """Per project of (project_id, requirement): counts of its tests (project_id, requirement, status) by state, and the share of requirements with a test that ran."""
    states = {"not_run": "not-run", "passed": "pass", "failed": "fail", "blocked": "blocked"}
    counts = tests.groupBy("project_id").agg(*[F.count_if(F.col("status") == v).alias(k) for k, v in states.items()])
    ran = tests.where("status <> 'not-run'").select("project_id", "requirement").distinct().withColumn("ran", F.lit(1))
    share = requirements.join(ran, ["project_id", "requirement"], "left").groupBy("project_id").agg(F.round(F.count("ran") / F.count("*"), 6).alias("coverage"))
    return share.join(counts, "project_id", "left").select("project_id", "coverage", *[F.coalesce(k, F.lit(0)).alias(k) for k in states])


def open_issues(tests: DataFrame, closed: DataFrame, key: str = "test_id") -> DataFrame:
    """Failed and blocked tests that ``closed`` does not name."""
    return tests.where("status in ('fail', 'blocked')").join(closed.select(key).distinct(), key, "left_anti")


def pareto(causes: DataFrame, cause: str, vital: float = 0.8) -> DataFrame:
    """Frequency of each cause, falling, with its running share; the causes up to the ``vital`` share are marked."""
    counts = causes.groupBy(cause).agg(F.count("*").alias("n"))
    total = causes.count()
    ranked = running_total(counts, [], [F.col("n").desc(), F.col(cause)], "n", "before")
    return ranked.select(cause, "n", F.round((F.col("before") + F.col("n")) / total, 6).alias("share"), (F.col("before") / total < vital).alias("vital"))


def completeness(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, total, missing) in one pass."""
    wide = rows.agg(F.count("*").alias("total"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return wide.unpivot("total", list(columns), "column", "missing")
