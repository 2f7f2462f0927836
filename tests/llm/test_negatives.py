"""Mined negatives against all pairs, over several slabs and digits."""

import math
import random

import pytest
from pyspark.sql import functions as F

from loomlog.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, low=80, high=100, k=5):
    of = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if i % 7 == 0 else label
        of[i] = min(of.get(i, (99, [])), (label, [math.floor(256 * x) for x in v]))
    out = []
    for a, (label, v) in of.items():
        if a % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, own) for i, (own, w) in of.items() if i != a and len(w) == len(v))
        for s, p, _ in [x for x in scored if x[2] == label][:5]:
            fit = [x for x in scored if x[2] != label and low * -s <= 100 * -x[0] <= high * -s][:k]
            out += [(a, p, n + 1, i, -s, -t) for n, (t, i, _) in enumerate(fit)]
    return sorted(out)


def mined(spark, rows, schema=SCHEMA, **more):
    df = spark.createDataFrame(rows, schema).repartition(3).withColumn("id", F.lit("other")).withColumn("score", F.lit(1))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return sorted(tuple(r) for r in negatives.mine(negatives.prepared(df, label), F.col("id") % 100 == 0, **more).collect())


def vectors(n, size, seed, spread=1.0):
    """Rows around ten centres, so that windows are full; every fourth vector is one of a few, so that scores tie."""
    rnd = random.Random(seed)
    middle = [rnd.gauss(0, 1) for _ in range(size)]
    few = [[m + rnd.gauss(0, 0.3) for m in middle] for _ in range(3)]
    return [(i, [round(x * spread, 4) for x in (few[rnd.randrange(3)] if i % 4 == 0 else [m + rnd.gauss(0, 0.5) for m in middle])], rnd.randrange(10)) for i in range(n)]


@pytest.mark.parametrize("spread, most", [(1.0, 4096), (0.05, 2), (300.0, 4096), (1e6, 4096)])
def test_against_all_pairs(spark, spread, most):
    rows = vectors(700, 8, 5, spread)
    want = brute([(i, [float(F32(x)) for x in v], label) for i, v, label in rows])
    assert len(want) > 20 and mined(spark, rows, most=most) == want


def F32(x):
    import numpy as np

    return np.float32(x)


def test_a_third_of_the_rows_are_one_vector(spark):
    rows = [(i, [0.5, 0.5, 0.25] if i % 3 == 0 else v[:3], label) for i, v, label in vectors(600, 8, 9)]
    rows = [(i, [float(F32(x)) for x in v], label) for i, v, label in rows]
    assert mined(spark, rows) == brute(rows)


def test_rows_that_take_no_part_and_odd_ones(spark):
    good = [(i, [float(F32(x)) for x in v], label) for i, v, label in vectors(300, 4, 3)]
    bad = [(None, [1.0] * 4, 1), (100_000, None, 1), (200_000, [1.0] * 4, None), (300_000, [1.0, None, 1.0, 1.0], 1), (400_000, [1.0, math.nan, 1.0, 1.0], 1), (500_000, [math.inf] * 4, 1), (5, [3e30] * 4, 1)]
    other = [(600_000 + i, [1.0] * 6, i % 3) for i in range(20)] + [(700_000 + i, [], i % 2) for i in range(9)]
    again = [good[0], good[0], (200, [9.0] * 4, 0), (1, [0.0] * 4, 9)]
    rows = good + other + again
    # the row beyond a long takes no part, as those with nulls
    got = mined(spark, rows + bad)
    assert got == brute(rows) and {g[0] for g in got} >= {600_000, 700_000}


def test_empty_tables_and_lone_anchors(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(100, [1.0], 1)]) == []
    assert mined(spark, [(100, [1.0], 1), (101, [1.0], 1)]) == []
    assert mined(spark, [(100, [1.0], 1), (101, [-1.0], 1), (102, [-1.0], 2)]) == []
    assert mined(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []


def test_other_windows(spark):
    rows = [(i, [float(F32(x)) for x in v], label) for i, v, label in vectors(400, 5, 2)]
    assert mined(spark, rows, k=2, low=50, high=120) == brute(rows, 50, 120, 2)
