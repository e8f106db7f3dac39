"""Personal data: texts with very many spans, the same evidence at several sizes, overlaps and replacement against plain loops."""

import random
import time

import pytest
from pyspark.sql import functions as F

from kbforge.llm import pii


def crowded(n):
    return "".join(f"write a{k}@ex{k}.org or b{k} [at] site{k}.com now " for k in range(n))


@pytest.mark.parametrize("n", [60, 500, 4000])
def test_same_evidence_has_the_same_outcome_at_any_size(spark, n):
    made = spark.createDataFrame([(1, crowded(n))], "doc_id long, text string")
    row = pii.personal_data(made).select(F.size("bases").alias("b"), F.size("spans").alias("s")).first()
    assert row.b == n and row.s >= 1.95 * n
    # and in many documents instead of one
    made = spark.createDataFrame([(k, crowded(1)) for k in range(n)], "doc_id long, text string")
    total = pii.personal_data(made).agg(F.sum(F.size("bases")).alias("b"), F.sum(F.size("spans")).alias("s")).first()
    assert total.b == n and total.s >= 1.95 * n


def test_many_spans_in_one_text(spark):
    took = []
    for n in (1000, 10000, 20000):  # the first warms up
        made = spark.createDataFrame([(1, crowded(n))], "doc_id long, text string")
        began = time.time()
        safe = pii.redact(made).first().text
        took.append(time.time() - began)
        assert safe.count("[EMAIL]") >= 1.95 * n and "@" not in safe
    assert took[2] < 4 * took[1] + 5 and took[2] < 60


def test_replacement_equals_plain_loops(spark):
    random.seed(4)
    rows = []
    for k in range(60):
        text = "".join(random.choice("aé😀\n ") for _ in range(random.randint(1, 900)))
        spans = sorted((a, random.randint(1, 4), min(len(text), a + random.choice([1, 3, 40, 700]))) for a in random.choices(range(len(text)), k=random.randint(1, 12)))
        rows.append((k, text, spans))
    df = spark.createDataFrame(rows, "k long, text string, spans array<struct<start:long,rank:int,stop:long>>")
    got = {r.k: r.t for r in df.select("k", pii.replaced(F.col("text"), F.col("spans"), 16).alias("t")).collect()}
    for k, text, spans in rows:
        at, out = 0, ""
        for a, rank, b in spans:
            out += text[at:a] + f"[{pii.KINDS[rank - 1].upper()}]"
            at = max(at, b)
        assert got[k] == out + text[at:]


def test_added_spans_equal_plain_loops(spark):
    random.seed(6)
    rows = list({(k, random.random() < 0.3, a, random.randint(1, 4), a + random.randint(1, 12)) for k in range(80) for a in random.choices(range(100), k=14)})
    df = spark.createDataFrame(rows, "uid long, base boolean, start long, rank int, stop long")
    want = []
    for k in range(80):
        bases, at = [r for r in rows if r[0] == k and r[1]], 0
        for _, _, a, rank, b in sorted((r for r in rows if r[0] == k and not r[1]), key=lambda r: (r[2], -r[4], r[3])):
            if a >= at and all(b <= x[2] or x[4] <= a for x in bases):
                want.append((k, a, rank, b))
                at = b
    assert sorted(map(tuple, pii.added_spans(df).collect())) == sorted(want)
