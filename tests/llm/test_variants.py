"""Spelling variants against SQL and brute force, over several ranges of the tries and odd words."""

import random
import re
import zlib
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from kbforge.llm import queries, variants

from test_llm import SF, documents, odd_documents


def near(x, y):
    if abs(len(x) - len(y)) > 1 or x == y:
        return False
    k = variants.common(x, y)
    return x[k + 1 :] == y[k + 1 :] if len(x) == len(y) else x[k:] == y[k + 1 :] if len(x) < len(y) else x[k + 1 :] == y[k:]


def brute(counts):
    forms, out = {}, []
    for w, n in counts.items():
        others = sorted((-m, v) for v, m in counts.items() if near(w, v))
        form = others[0][1] if others and -others[0][0] >= 2 * n else None
        forms[w] = (n, len(others), form)
    for w, (n, many, form) in forms.items():
        root = w
        while forms[root][2]:
            root = forms[root][2]
        out.append((w, n, many, form, counts.get(form), root))
    return sorted(out)


def grouped(spark, counts):
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    return sorted(tuple(r) for r in variants.group_variants(df).select("word", "n", "n_near", "form", "form_n", "root").collect())


def test_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    found = con.sql(queries.oracle_sql()["op11_variants"])
    got = queries.op11_variants(spark, SF).select(*found.columns).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, found.fetchall())) and got


def test_dense_words_over_many_ranges(spark):
    """Three letters only, so ranges of the sorted words begin inside deep subtrees; runs of equal letters; counts that tie and chain."""
    random.seed(11)
    counts = {"".join(random.choices("abÿ", k=random.randint(5, 8))): random.choice([3, 3, 4, 6, 7, 12, 15, 50, 200]) for _ in range(700)}
    counts |= {"a" * k: 3 * 2 ** (k - 5) for k in range(5, 12)}
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert grouped(spark, counts) == brute(counts)
        numbered = variants.with_nodes(spark.createDataFrame(list(counts.items()), "word string, n long"), "word", "fore")
        assert numbered.select(F.shiftright("place", 40)).distinct().count() > 4
        assert variants.same_nodes(numbered, "word", "fore")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_a_form_that_leads_many_words(spark):
    counts = {f"{a}{b}cdefg": 3 for a in "abcdefghij" for b in "abcdefghij"} | {"aacdefg": 90, "aacdefgh": 500}
    assert grouped(spark, counts) == brute(counts)


def test_very_long_words_and_none(spark):
    long = "ab" * 40000
    counts = {long: 3, long + "c": 9, "x" + long: 4, long[:1000]: 3, "apart": 5}
    assert grouped(spark, counts) == brute(counts)
    assert grouped(spark, {}) == []


def test_slips_and_runs(spark):
    rows = [(k, t) for k, t in ((r.doc_id, r.text) for r in documents(spark).collect())] + [(900000 + k, "Éxemple exemple EXEMPLE ×÷ Ünïcodeß naïve-naïve x 9ab_cd") for k in range(300)] + [(None, "withoutid " * 4), (5, None)]
    want = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{doc}:{run}".encode())
            if doc is not None and h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            want[run] += 1
    got = variants.word_counts(spark.createDataFrame(rows, "doc_id long, text string"), slips=97).collect()
    assert dict(map(tuple, got)) == {w: n for w, n in want.items() if len(w) >= 5 and n >= 3}


def test_tasks_hand_counts_on(spark, monkeypatch):
    monkeypatch.setattr(variants, "HELD", 3)
    counted = variants.word_counts(spark.createDataFrame([(k, "alpha betas gamma delta omega") for k in range(9)], "doc_id long, text string").coalesce(1))
    assert {r.word: r.n for r in counted.collect()} == dict.fromkeys(["alpha", "betas", "gamma", "delta", "omega"], 9)


def test_odd_tables(spark):
    odd = odd_documents(spark)
    assert {r.word for r in variants.group_variants(variants.word_counts(odd)).collect()} <= {"three", "seven", "mail", "a" * 3000, "é" * 50}
    assert variants.group_variants(variants.word_counts(odd.limit(0))).collect() == []
