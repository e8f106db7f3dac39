"""Operational logs: loops, drift, rate limits, streaks, routing and history windows."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import literals

#: Phrase lists of the router and the drift check.
COMPLEX_ZH = ["分步骤", "第一步", "第二步", "第三步", "然后", "接着", "最后", "流程", "方案", "架构", "设计", "重构", "迁移", "集成", "部署", "整体", "规划", "计划", "阶段", "里程碑"]
COMPLEX_EN = ["step by step", "first", "then", "finally", "next", "plan", "architect", "design", "refactor", "migrate", "batch", "multiple", "all", "entire", "system", "workflow", "pipeline", "milestone", "phase"]
SIMPLE = ["查询", "搜索", "查找", "什么", "多少", "是否", "search", "find", "what", "how many"]
DRIFT = ["接下来我将", "同时我也会", "综合以上所有步骤", "跳过", "我决定改为", "Next I will", "Furthermore", "In summary", "skip", "I decide to", "instead", "let me also"]

#: Words that mark a step's output as failed.
STEP_FAILURES = ["失败", "错误", "error", "failed", "exception", "超时", "timeout", "不支持", "not supported"]
#: What is learned from a failure, by its kind and by words of its reason; those that end in a blank go on with the reason.
RULES = {
    "empty": "stop when a tool returns nothing, and say so",
    "timeout": "after a timeout take a smaller request or another tool",
    "unsupported": "name an unsupported feature to the user at once",
    "exhausted": "retries ran out, look into: ",
    "replan": "the plan was blocked, plan anew around: ",
    "one_timeout": "do not wait twice for the same call",
    "other": "take note of: ",
}


def repeated_calls(calls: DataFrame, allowed: int = 3) -> DataFrame:
    """Calls of the same tool with the same first 100 bytes of arguments beyond ``allowed`` in a step."""
    key = F.substring(F.encode("args", "UTF-8"), 1, 100)
    nth = F.row_number().over(Window.partitionBy("session_id", "step", "tool", key).orderBy("started_at", "call_id"))
    return calls.withColumn("nth", nth.cast("long")).where(F.col("nth") > allowed)


def disallowed_calls(calls: DataFrame, allowed: DataFrame) -> DataFrame:
    """Calls whose (step, tool) is not in the list."""
    return calls.join(allowed, ["step", "tool"], "left_anti")


def plan_drift(steps: DataFrame) -> DataFrame:
    """``steps`` (planned_tool, tool, output) with ``drift``: a phrase in the output, else another tool than planned, else a tool in a step without."""
    phrase = F.try_element_at(F.filter(literals(DRIFT), lambda p: F.contains("output", p)), F.lit(1))
    wrong = F.col("planned_tool").isNotNull() & (F.col("tool") != F.col("planned_tool"))
    return steps.withColumn("drift", F.when(phrase.isNotNull(), F.concat(F.lit("phrase:"), phrase)).when(wrong, "tool").when(F.col("planned_tool").isNull() & F.col("tool").isNotNull(), "no_tool"))


def step_failure(output: Column, expected: Column) -> Column:
    """Why a step's output fails: ``empty``, ``word:`` and the first failure word, ``short`` (under 10 bytes where over 50 were expected), or null."""
    low = F.lower(output)
    word = F.try_element_at(F.filter(literals(STEP_FAILURES), lambda w: F.contains(low, w)), F.lit(1))
    blank = F.coalesce(F.trim(output, F.lit(" \t\r\n")), F.lit("")) == ""
    short = (F.octet_length(output) < 10) & (F.octet_length(expected) > 50)
    return F.when(blank, "empty").when(word.isNotNull(), F.concat(F.lit("word:"), word)).when(short, "short")


def rule_of(kind: Column, reason: Column, rules: Mapping[str, str] = RULES) -> Column:
    """The rule that a failure of a kind (exhausted, replan, timeout, any other) teaches, in the words of ``rules``."""
    has = lambda *words: F.contains(reason, F.lit(words[0])) | F.contains(reason, F.lit(words[1]))
    told = lambda name: F.concat(F.lit(rules[name]), F.left(reason, F.lit(80)))
    exhausted = F.when(has("为空", "empty"), rules["empty"]).when(has("超时", "timeout"), rules["timeout"]).when(has("不支持", "not supported"), rules["unsupported"]).otherwise(told("exhausted"))
    return F.when(kind == "exhausted", exhausted).when(kind == "replan", told("replan")).when(kind == "timeout", rules["one_timeout"]).otherwise(told("other"))


def failure_streaks(results: DataFrame, most: int, order: Sequence[str]) -> DataFrame:
    """``results`` (session_id, failed) with the running ``streak`` of failures and whether it calls for a new plan."""
    by = Window.partitionBy("session_id").orderBy(*order)
    island = results.withColumn("__island", F.sum((~F.col("failed")).cast("long")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    streak = F.sum(F.col("failed").cast("long")).over(Window.partitionBy("session_id", "__island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return island.withColumn("streak", streak).withColumn("replan", F.col("streak") >= most).drop("__island")


def rate_audit(calls: DataFrame, most: int, seconds: int = 60) -> DataFrame:
    """``calls`` with how many of the session's calls fall into the last ``seconds`` (this one included), over ``most`` or not."""
    at = F.unix_micros(F.col("started_at").cast("timestamp"))
    span = Window.partitionBy("session_id").orderBy(at).rangeBetween(-seconds * 1_000_000, 0)
    return calls.withColumn("recent", F.count("*").over(span)).withColumn("over", F.col("recent") > most)


def rate_limit(calls: DataFrame, most: int, seconds: int = 60) -> DataFrame:
    """(session_id, call_id, accepted): exact decisions, where only accepted calls count; the state of a session is its last ``most`` accepted times.

    Calls stream through a task sorted by session and time, so a session of any length takes
    bounded memory.
    """
    ordered = calls.select("session_id", "call_id", F.unix_micros(F.col("started_at").cast("timestamp")).alias("at")).repartition("session_id").sortWithinPartitions("session_id", "at", "call_id")

    def decide(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, held = None, []
        for frame in frames:
            out = []
            for s, at in zip(frame["session_id"], frame["at"]):
                if s != session:
                    session, held = s, []
                held = [t for t in held if at - t < seconds * 1_000_000]
                out.append(len(held) < most)
                if out[-1]:
                    held.append(at)
            yield pd.DataFrame({"session_id": frame["session_id"], "call_id": frame["call_id"], "accepted": out})

    return ordered.mapInPandas(decide, "session_id long, call_id long, accepted boolean")


def complexity(text: Column, earlier: Column, threshold: int = 24) -> tuple[Column, Column]:
    """(score, mode) of a message with ``earlier`` messages before it.

    Three points a phrase, one for each 200 bytes (at most 5), two for each 4 turns (at most 6);
    then five off for each simple word, never below zero.
    """
    low = F.lower(text)
    hits = lambda where, words: F.size(F.filter(literals(words), lambda w: F.contains(where, w)))
    points = 3 * hits(text, COMPLEX_ZH) + 3 * hits(low, COMPLEX_EN) + F.least(F.floor(F.octet_length(text) / 200), F.lit(5)) + 2 * F.least(F.floor(F.floor(earlier / 2) / 4), F.lit(3))
    score = F.greatest(points - 5 * hits(low, SIMPLE), F.lit(0)).cast("long")
    return score, F.when(score >= threshold, "planned").otherwise("direct")


def intent_flag(text: Column, words: Sequence[str], least: int = 2) -> Column:
    low = F.lower(text)
    return F.size(F.filter(literals([w.lower() for w in words]), lambda w: F.contains(low, w))) >= least


def history_within(turns: DataFrame, budget: int) -> DataFrame:
    """(conv_id, turns, chars): the newest messages of each conversation whose running length stays within ``budget``."""
    newest = Window.partitionBy("conv_id").orderBy(F.col("turn").desc()).rowsBetween(Window.unboundedPreceding, 0)
    kept = turns.withColumn("used", F.sum(F.char_length("text")).over(newest)).where(F.col("used") <= budget)
    return kept.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"), F.max("used").alias("chars"))
