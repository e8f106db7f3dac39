"""Checks of generated answers against the texts they were made from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from .retrieval import cosine

#: Hedging words and words that state a product fact.
HEDGES = ["可能", "应该", "一般来说", "通常", "据说", "maybe", "probably", "usually", "generally"]
#: Words that deny a fact, and words that affirm one.
NEGATIONS = ["不支持", "无法", "不能", "不可", "没有"]
AFFIRMATIONS = ["支持", "可以", "能", "可", "有"]
PLEASANTRIES = ["你好", "请问", "抱歉", "谢谢", "可以", "请", "您好", "总结", "根据", "综上所述"]


def citation_check(answers: DataFrame) -> DataFrame:
    """(answer_id, passed, confidence) of (answer_id, cited array, available array): share of cited names or ids that are available; without any, passed at 0.7."""
    found = F.size(F.filter("cited", lambda c: F.exists("available", lambda a: F.contains(a, c))))
    n = F.size("cited")
    return answers.select("answer_id", ((n == 0) | (found == n)).alias("passed"), F.when(n == 0, 0.7).otherwise(F.round(found / n, 6)).alias("confidence"))


def grounding(sentences: DataFrame, grams: Column, context: str = "context", share: float = 0.6, negations: Sequence[str] = NEGATIONS, affirmations: Sequence[str] = AFFIRMATIONS, pleasantries: Sequence[str] = PLEASANTRIES) -> DataFrame:
    """``sentences`` with ``supported``: null for sentences that claim nothing (they begin with one of ``pleasantries``).

    Of the others, at most ``share`` of the n-grams may be missing from the context, where each of
    ``negations`` in the sentence counts as missing if the context holds one of ``affirmations`` and
    not that negation. Without n-grams no such mismatch may occur.
    """
    words = lambda w: t.literals(list(w)) if w else F.array().cast("array<string>")
    sentence, known = F.col("sentence"), F.coalesce(F.col(context), F.lit(""))
    affirmed = F.exists(words(affirmations), lambda w: F.contains(known, w))
    mismatches = F.when(affirmed, F.size(F.filter(words(negations), lambda w: F.contains(sentence, w) & ~F.contains(known, w)))).otherwise(0)
    missing = F.size(F.filter(F.col("__g"), lambda g: ~F.contains(known, g))) + mismatches
    n = F.size("__g")
    claim = ~F.exists(words(pleasantries), lambda w: F.startswith(sentence, w))
    return sentences.withColumn("__g", grams).withColumn("supported", F.when(claim, F.when(n == 0, mismatches == 0).otherwise(missing <= F.floor(n * share)))).drop("__g")


def grounding_verdict(sentences: DataFrame, least: float = 0.8, context: str | None = None) -> DataFrame:
    """(answer_id, ratio, passed) from (answer_id, supported), null where nothing is claimed.

    Answers without claims pass at 1.0. If ``context`` names a column, answers whose context is null
    or empty everywhere pass at 0.5.
    """
    ratio = F.coalesce(F.round(F.avg(F.col("supported").cast("int")), 6), F.lit(1.0))
    blank = F.max(F.coalesce(F.col(context), F.lit("")) != "") == F.lit(False) if context else F.lit(False)
    found = sentences.groupBy("answer_id").agg(ratio.alias("ratio"), blank.alias("blank"))
    return found.select("answer_id", F.when(F.col("blank"), 0.5).otherwise(F.col("ratio")).alias("ratio"), (F.col("blank") | (F.col("ratio") >= least)).alias("passed"))


def vector_grounding(pairs: DataFrame, ok: float = 0.7, weak: float = 0.4) -> DataFrame:
    """(sentence_id, chunk_id, similarity, verdict): each sentence's nearest chunk among (sentence_id, chunk_id, sv, cv)."""
    scored = pairs.withColumn("similarity", F.round(cosine(F.col("sv"), F.col("cv")), 6))
    best = scored.groupBy("sentence_id").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "chunk_id")).alias("b"))
    s = -F.col("b.s")
    return best.select("sentence_id", F.col("b.chunk_id").alias("chunk_id"), s.alias("similarity"), F.when(s >= ok, "supported").when(s >= weak, "weak").otherwise("unsupported").alias("verdict"))


def contradictions(sentences: DataFrame, grams: Column, negations: Sequence[str]) -> DataFrame:
    """(answer_id, i, j): sentence pairs that share an n-gram of which one is negated.

    Affirmed and negated sentences of an answer meet on a shared gram only; nothing is paired
    inside one side.
    """
    negated = F.exists(t.literals([f" {w} " if w.isascii() else w for w in negations]), lambda w: F.contains(F.concat(F.lit(" "), F.lower("sentence"), F.lit(" ")), w))
    rows = sentences.withColumn("negated", negated).select("answer_id", "n", "negated", F.explode(F.array_distinct(grams)).alias("gram"))
    a = rows.where("not negated").select("answer_id", "gram", F.col("n").alias("x"))
    b = rows.where("negated").select("answer_id", "gram", F.col("n").alias("y"))
    return a.join(b, ["answer_id", "gram"]).select("answer_id", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j")).distinct()


def hedging(sentences: DataFrame, assertions: Sequence[str], hedges: Sequence[str] = HEDGES) -> DataFrame:
    """(answer_id, issues, confidence): hedged sentences and product facts without source; confidence is the share of others."""
    has = lambda words: F.exists(t.literals(words), lambda w: F.contains("sentence", w))
    hedged = has(hedges)
    bare = has(assertions) & ~hedged & ~F.col("sentence").rlike(r"来源：|\[src:|\[chunk:")
    counts = sentences.groupBy("answer_id").agg(F.count_if(hedged | bare).alias("issues"), F.count("*").alias("n"))
    return counts.select("answer_id", "issues", F.round(1 - F.col("issues") / F.greatest("n", F.lit(1)), 6).alias("confidence"))


def report(checks: DataFrame) -> DataFrame:
    """(answer_id, level, confidence, labels) from (answer_id, check_name, passed, confidence)."""
    failed = lambda name, label: F.when(F.count_if((F.col("check_name") == name) & ~F.col("passed")) > 0, label)
    total, passed, mean = F.count("*"), F.count_if("passed"), F.avg("confidence")
    level = (
        F.when((passed == total) & (mean >= 0.8), "confirmed").when(passed == total, "needs_review").when(passed == 0, "failed").when(passed >= F.floor(total / 2), "needs_review").otherwise("suspected")
    )
    labels = F.array_compact(F.array(failed("citation", "citation_missing"), failed("grounding", "not_grounded"), failed("contradiction", "contradiction"), F.when(F.min("confidence") < 0.5, "low_confidence")))
    return checks.groupBy("answer_id").agg(level.alias("level"), F.round(mean, 6).alias("confidence"), F.array_join(labels, ",").alias("labels"))


def neighbours_in_document(chunks: DataFrame) -> DataFrame:
    """``chunks`` with the contents of the chunk before and after in their document."""
    by = Window.partitionBy("document_id").orderBy("line_no")
    return chunks.withColumn("previous", F.lag("content").over(by)).withColumn("next", F.lead("content").over(by))
