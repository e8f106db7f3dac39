"""Logical deletes: merge on read, replaced rows, which folders are rewritten, and a folder that dies whole."""

from kbforge.operators import vectortable as vt


def test_deletes_and_compaction(spark, tmp_path):
    path = str(tmp_path / "v")
    rows = lambda ids, x: spark.createDataFrame([(k, [x]) for k in ids], "vec_id long, embedding array<double>")
    ids = lambda ks: spark.createDataFrame([(k,) for k in ks], "vec_id long")
    live = lambda: {r.vec_id: r.embedding[0] for r in vt.read_live(spark, path).collect()}
    vt.append(path, rows(range(40), 1.0), 1, 4)
    assert live() == {k: 1.0 for k in range(40)}
    vt.delete(path, ids([0, 4, 8, 1, *range(2, 40, 4)]), 2)  # 3 of folder 0, 1 of folder 1, all of folder 2
    vt.append(path, rows([4, 7], 3.0), 3, 4)  # 4 comes back, 7 is replaced
    want = {k: 1.0 for k in range(40) if k % 4 != 2 and k not in (0, 8, 1)} | {4: 3.0, 7: 3.0}
    assert live() == want
    done = {r.folder: (r.stored, r.dead, r.rewritten) for r in vt.compact(spark, path).collect()}
    assert done == {0: (11, 3, True), 1: (10, 1, False), 2: (10, 10, True), 3: (11, 1, False)}
    assert live() == want
    left = {r.folder: r["count"] for r in spark.read.parquet(f"{path}/rows").groupBy("folder").count().collect()}
    assert left == {0: 8, 1: 10, 3: 11}
    assert not any(r.rewritten for r in vt.compact(spark, path).collect()) and live() == want
