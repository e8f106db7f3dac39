"""Hard negatives against brute force, on clustered, repeated and odd vectors."""

import math

import duckdb
import numpy as np
import pytest

from kbforge.llm import negatives, queries

from test_llm import SF


def brute(rows, is_anchor=lambda i: i % 100 == 0):
    fine = [(i, [math.floor(256 * float(np.float32(c))) for c in x], y) for i, x, y in rows if i is not None and x and y is not None and all(c is not None and math.isfinite(c) for c in x)]
    anchors = {}
    for i, x, y in fine:
        if is_anchor(i):
            anchors[i] = min(anchors.get(i, (y, x)), (y, x))
    out = []
    for a, (label, x) in anchors.items():
        dot = lambda z: sum(p * q for p, q in zip(x, z))  # noqa: E731, B023
        others = [(-dot(z), i, y) for i, z, y in fine if i != a and len(z) == len(x)]
        for s, p, _ in sorted(o for o in others if o[2] == label)[:5]:
            hard = sorted((t, i) for t, i, y in others if y != label and 30 * -s <= 100 * -t <= 90 * -s)[:10]
            out += [(a, p, k + 1, i, -s, -t) for k, (t, i) in enumerate(hard)]
    return sorted(out)


def mined(df, **kw):
    return sorted(tuple(r) for r in negatives.hard_negatives(df, **kw).collect())


SCHEMA = "vec_id long, embedding array<float>, label int, score long, place string, dims string"


def test_equals_sql(spark):
    df = queries.op12_negatives(spark, SF)
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    want = con.sql(queries.oracle_sql()["op12_negatives"]).fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want) and want


@pytest.mark.parametrize("spread", [0.02, 0.5])
def test_small_units_equal_brute_force(spark, spread):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 8))
    rows = [(k, (centres[k % 6] + spread * rng.normal(size=8)).tolist(), int(rng.integers(0, 4)), 1, "p", "d") for k in range(700)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute([r[:3] for r in rows], lambda i: i % 10 == 0)
    assert mined(df, is_anchor="vec_id % 10 = 0", shard_numbers=1 << 10, group_numbers=1 << 6) == want
    assert mined(df, is_anchor="vec_id % 10 = 0") == want


def test_odd_rows(spark):
    rows = [
        (0, [1.0, 2.0], 1), (0, [1.0, 2.0], 1), (100, [1.0, 2.0], 1), (200, None, 1), (300, [1.0, None], 1), (400, [1.0, float("nan")], 2), (500, [float("inf"), 1.0], 2), (600, [], 2), (None, [1.0, 2.0], 1),
        (700, [1.0, 2.0], None), (800, [0.0, 0.0], 3), (900, [-1.0, -2.0], 3), (1000, [1.0, 2.0, 3.0], 1), (1100, [1.0, 2.5, 3.0], 1), (7, [0.5, 1.0], 2), (8, [0.5, 1.0], 2), (8, [0.5, 1.0], 2), (9, [0.5, 1.0, 1.0], 5), (1, [1.0, 2.0], 1), (2, [0.9, 1.9], 1), (3, [0.0, 0.0], 3),
    ]
    df = spark.createDataFrame([(*r, 1, "p", "d") for r in rows], SCHEMA)
    assert mined(df) == brute(rows)
    assert negatives.hard_negatives(df.limit(0)).collect() == []


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(1)
    centre = rng.integers(-200, 200, size=16)
    anchors = centre + rng.integers(-3, 4, size=(60, 16))
    rows = rng.integers(-200, 200, size=(500, 16))
    scored = []

    def asked(a, low, high):
        true = rows @ anchors[a]
        assert (low <= true).all() and (true <= high).all()
        return high >= negatives._least(low, 5)

    for a, places, scores in negatives.tree_scores(anchors, rows, asked):
        assert (scores == rows[places] @ anchors[a]).all()
        scored.append(len(places))
    assert len(scored) == 60 and sum(scored[1:]) < 0.5 * 59 * 500  # neighbouring anchors need few exact scores


def test_large_numbers_stay_exact():
    for size in (1 << 11, 1 << 23, 1 << 29):
        rng = np.random.default_rng(2)
        anchors, rows = rng.integers(-size, size, (9, 4)), rng.integers(-size, size, (80, 4))
        for a, places, scores in negatives.tree_scores(anchors, rows, lambda a, low, high: high >= negatives._least(low, 3)):
            true = rows @ anchors[a]
            assert (scores == true[places]).all() and set(np.argsort(-true)[:3]) <= set(places)
