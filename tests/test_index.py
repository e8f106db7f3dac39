"""The fielded index against plain loops: slots, turns, exclusions, folding, pruned reading."""

import glob
import math
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kbforge.operators import index, retrieval
from kbforge.plans import search_queries, stream_queries
from kbforge.sources import scratch

WORDS = [f"w{k}" for k in range(14)]


def fields():
    return {"title": F.split("title", " "), "content": F.filter(F.split("content", " "), lambda w: w != "")}


@pytest.fixture(scope="module")
def rows():
    random.seed(23)
    text = lambda n: " ".join(random.choices(WORDS, [2.0 ** -k for k in range(14)], k=n))
    return [(k, k // 3 * 3, text(random.randint(1, 3)), text(random.randint(0, 9))) for k in range(400)]


@pytest.fixture(scope="module")
def made(spark, rows):
    df = spark.createDataFrame(rows, "chunk_id long, parent long, title string, content string")
    return index.build_index(df, fields(), owner="parent", slot_chunks=50, buckets=4)


def brute(rows, asked, k, excluded=(), fold=False):
    texts = {f: {r[0]: [w for w in r[i].split(" ") if w] for r in rows} for f, i in (("title", 2), ("content", 3))}
    whole = {f: {c: t for c, t in ts.items() if t} for f, ts in texts.items()}
    mean = {f: sum(map(len, ts.values())) / len(ts) for f, ts in whole.items()}
    out = []
    for q, words in asked.items():
        scores = {}
        for c, parent, *_ in rows:
            total = 0
            for f, ts in whole.items():
                t = ts.get(c, [])
                for w in set(words):
                    df, tf = sum(w in x for x in ts.values()), t.count(w)
                    if tf:
                        total += math.log(1 + (len(ts) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / mean[f]))
            if total and c not in excluded:
                key = parent if fold else c
                scores[key] = max(scores.get(key, 0), round(total, 6))
        out += [(q, c, n + 1) for n, (s, c) in enumerate(sorted((-s, c) for c, s in scores.items())[:k])]
    return sorted(out)


def queries_of(spark, asked):
    return spark.createDataFrame([(q, w) for q, ws in asked.items() for w in ws] + [(9, None), (None, "w1")], "query_id long, term string")


@pytest.mark.parametrize("fold", [False, True])
@pytest.mark.parametrize("limits", [{}, {"most_weights": 6}, {"most_best": 9}])
def test_equals_plain_loops(spark, rows, made, fold, limits):
    assert made.slots == 8
    asked = {1: ["w0", "w5"], 2: ["w13"], 3: ["w1", "w2", "w3", "none"], 4: ["none"], 5: ["w0"], 6: ["w0", "w0"]}
    gone = list(range(0, 400, 7))
    excluded = spark.createDataFrame([(c, c // 3 * 3) for c in gone], "key long, owner long")
    for e, frame in (((), None), (gone, excluded)):
        got = index.search(made, queries_of(spark, asked), 4, frame, fold, **limits).collect()
        assert sorted((r.query_id, r.key, r["rank"]) for r in got) == brute(rows, asked, 4, e, fold)


def test_reads_only_asked_folders(spark, made):
    plan = index.asked_blocks(made, spark.createDataFrame([("w3",)], "term string"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan


def test_a_task_passes_on_its_best_only(spark):
    """Twenty thousand queries, two hundred deep: at most a task's queries times k rows leave it, not each match."""
    lists = retrieval.posting_lists(spark.range(0, 600, 1, 2).select(F.lit("p").alias("project_id"), F.col("id").alias("chunk_id")), F.array(F.lit("a"), F.lit("b")))
    weights = pa.table({"query_id": range(20000), "term": ["a"] * 20000, "idf": [1.0] * 20000})
    scorer = retrieval._scorer(spark.sparkContext.broadcast(weights), "chunk_id", 200, 1.2, 0.75, 2.0)
    passed = lists.select("chunk_id", "dl", "terms").mapInArrow(scorer, "query_id long, chunk_id long, score double")
    assert passed.count() == 2 * 20000 * 200
    assert sorted(r.chunk_id for r in passed.where("query_id = 77").collect()) == [*range(200), *range(300, 500)]
    asked = spark.range(5000).select(F.col("id").alias("query_id"), F.lit("a").alias("term"))
    assert retrieval.bm25(asked, lists, 200, most_best=1 << 18).count() == 5000 * 200  # in turns


def test_empty(spark, made):
    none = spark.createDataFrame([], "query_id long, term string")
    assert index.search(made, none).collect() == []
    bare = index.build_index(spark.createDataFrame([], "chunk_id long, title string, content string"), fields())
    assert index.search(bare, queries_of(spark, {1: ["w1"]})).collect() == []


def test_tasks_pass_lists_on():
    """A task gives one packed list for each term, field and part of slots, in order of slots, and the blocks of several tasks' lists are whole."""
    batch = lambda at: pa.record_batch([pa.array(at), pa.array(at), pa.array([k % 40 for k in at], pa.int32()), pa.array([["a", "b", "a"]] * len(at))], ["key", "owner", "slot", "tokens_0"])
    tasks = [pa.Table.from_batches(index._lister(["content"])(iter([batch(range(n, n + 100)), batch(range(n + 100, n + 200))]))).to_pylist() for n in (0, 200)]
    for rows in tasks:
        assert [(r["term"], r["part"], r["n"], r["length"]) for r in rows] == [("a", 0, 160, None), ("a", 1, 40, None), ("b", 0, 160, None), ("b", 1, 40, None), (None, None, 200, 600)]
    rows = sorted((dict(r, bucket=0) for rows in tasks for r in rows if r["term"]), key=lambda r: (r["term"], r["part"], r["first"]))
    lists = pa.RecordBatch.from_pylist(rows, pa.schema([("bucket", pa.int32()), ("term", pa.string()), ("field", pa.string()), ("n", pa.int64()), ("length", pa.int64()), ("postings", pa.binary())]))
    blocks = [r for b in index._blocks(iter([lists])) for r in b.to_pylist()]
    assert [(r["term"], r["slot"], r["n"]) for r in blocks] == [(t, s, 10) for t in "ab" for s in range(40)]
    found, ends = index._unpacked(pa.array([blocks[3]["postings"]]))
    assert found["key"].tolist() == list(range(3, 400, 40)) and set(found["tf"]) == {2} and ends.tolist() == [0, 10]


def test_packed_postings_are_small_and_whole():
    """Any long comes back, whatever rows are packed or read together; lines of documents take a third of the bytes that their numbers have."""
    rng, of = np.random.default_rng(2), np.iinfo(np.int64)
    made = np.empty(5000, index.POSTING)
    made["key"], made["owner"] = (rng.integers(of.min, of.max, 5000, endpoint=True) for _ in range(2))
    made["key"][:2002] = [of.min, of.max, *np.sort(rng.integers(0, 50000, 2000) * 2**31 + rng.integers(0, 300, 2000))]
    made["owner"][2:2002] = made["key"][2:2002]
    made["slot"], made["tf"], made["length"] = 5, rng.integers(1, 9, 5000), rng.integers(0, 3000, 5000)
    made["slot"][2002:] = rng.integers(0, 2**31, 2998)
    offsets = np.array([0, 0, 2, 2002, 2003, 4000, 5000, 5000])
    for at_once in (1, 1500, 1 << 20):
        packed = index._packed(made, offsets, at_once)
        found, ends = index._unpacked(packed)
        assert (found == made).all() and (ends == offsets).all()
        assert (index._unpacked(packed.slice(2, 3))[0] == made[2:4000]).all()
        parts = list(index._spans(pa.RecordBatch.from_arrays([packed], ["postings"]), 10000))
        assert pa.Table.from_batches(parts)["postings"].to_pylist() == packed.to_pylist() and len(parts) > 2
    assert len(packed[2].as_py()) < 2000 * index.POSTING.itemsize / 3
    found, ends = index._unpacked(pa.array([None, packed[3].as_py(), None], pa.binary()))
    assert (found == made[2002:2003]).all() and ends.tolist() == [0, 0, 1, 1]


def test_parcels_hold_all_lists():
    batch = pa.RecordBatch.from_arrays([pa.array(range(900)), pa.array(range(900)), pa.array([k % 600 for k in range(900)], pa.int32()), pa.array([[f"w{k % 7}", "a"] for k in range(900)])], ["key", "owner", "slot", "tokens_0"])
    lists = [r for b in index._lister(["content"], slots=index.WIDE)(iter([batch])) for r in b.to_pylist()]
    parcels = [r for b in index._parcels(["content"], 4)(iter([batch])) for r in b.to_pylist()]
    opened = [r for b in index._opened(iter([pa.RecordBatch.from_pylist(parcels)])) for r in b.to_pylist()]
    assert len({(p["bucket"], p["part"]) for p in parcels}) == len(parcels) and {p["part"] for p in parcels} == {-1, 0, 1, 2}
    by = lambda rows: sorted((tuple(r[c] for c in index.LIST) for r in rows), key=repr)
    assert by(opened) == by(lists) and {r["bucket"] for r in opened if r["term"] is None} == {index.TOTALS}


def test_what_is_stored_leaves_no_shuffle_files(spark, rows):
    dirs = list(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    files = lambda: {f for d in dirs for f in glob.glob(f"{d}/*/shuffle_*.data")}
    before, kept = files(), spark.conf.get(scratch.CLEANUP, None)
    index.build_index(spark.createDataFrame(rows, "chunk_id long, parent long, title string, content string"), fields(), slots=3)
    assert scratch.stored(spark.range(1000).repartition(5), "rows").count() == 1000
    until = time.time() + 20
    while files() - before and time.time() < until:  # they are deleted in the background
        time.sleep(0.2)
    left = {f.split("/shuffle_")[1].split("_")[0] for f in files() - before}
    assert len(left) <= 2 and spark.conf.get(scratch.CLEANUP, None) == kept  # of the counts, which keep their few bytes


@pytest.mark.parametrize("make,owner", [(search_queries._titled_lines, None), (search_queries._small_to_big, "owner")])
def test_an_index_built_in_batches_is_the_same(spark, make, owner):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    sums = lambda made: sorted(map(tuple, made.blocks.groupBy("term", "field", "slot").agg(F.sum("n"), F.sum("cf"), F.max("max_tf"), F.min("min_length")).collect()))
    one, two = (search_queries._indexed(docs, make, 3, owner, least) for least in (1 << 30, 1 << 10))
    assert sums(one) == sums(two) and two.blocks.count() > one.blocks.count()


def test_several_files_are_ingested_in_four_batches(spark, tmp_path):
    """The terms are those of one batch, and what a batch has shuffled is gone after it."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs.repartition(8, "doc_id").write.parquet(str(tmp_path / "documents.parquet"))
    made = lambda: set(glob.glob(f"{scratch.fresh_dir(spark, 'x').removeprefix('file://').rsplit('/', 1)[0]}/ingest-*/index/blocks/batch=*"))
    known = made()
    terms = lambda d: sorted(map(tuple, stream_queries.QUERIES["st5_index"](spark, d).collect()))
    found = terms(str(tmp_path))
    assert len(made() - known) == 4
    assert found == terms("/root/testdata/sf0.001") != []
