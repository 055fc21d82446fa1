"""Hard negatives against a plain search."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tightknit.llm.hard_negatives import hard_negatives

SHAPE = "vec_id bigint, embedding array<double>, label int"


def brute(rows, anchors, k=5, percent=80, scale=256):
    kept = {}
    for vec_id, vector, label in rows:
        if None in (vec_id, vector, label) or any(x is None or not math.isfinite(x) for x in vector):
            continue
        entry = (label, [math.floor(scale * x) for x in vector])
        kept[vec_id] = min(kept.get(vec_id, entry), entry)
    found = set()
    for a, (label, q) in kept.items():
        if not anchors(a):
            continue
        scored = [(sum(x * y for x, y in zip(q, r)), -i, other) for i, (other, r) in kept.items() if i != a]
        scored.sort(reverse=True)
        for p, minus_p, _ in [s for s in scored if s[2] == label][:k]:
            negatives = [(n, -i) for n, i, other in scored if other != label and percent * p <= 100 * n <= 100 * p]
            for rank, (n, i) in enumerate(negatives[:k], 1):
                found.add((a, -minus_p, rank, i, p, n))
    return found


def run(spark, rows, shape=SHAPE, **options):
    frame = spark.createDataFrame(rows, shape).withColumns({c: F.lit("clash") for c in ("q", "block", "shard", "score", "upper")})
    got = [tuple(r) for r in hard_negatives(frame, F.col("vec_id") % 4 == 0, **options).collect()]
    assert len(got) == len(set(got))
    return set(got)


def vectors(n, dim, seed, scale=1.0):
    rng = random.Random(seed)
    centers = [[rng.gauss(0, scale) for _ in range(dim)] for _ in range(3)]
    rows = []
    for i in range(n):
        center = rng.choice(centers)
        rows.append((i, [round(x + rng.gauss(0, scale / 4), 2) for x in center], rng.choice([0, 0, 0, 1, 2])))
    return rows


@pytest.mark.parametrize("row_values, anchor_values", [(1 << 22, 1 << 20), (80, 40)])
def test_all_blocks_agree_with_a_plain_search(spark, row_values, anchor_values):
    rows = vectors(90, 8, 1)
    got = run(spark, rows, row_values=row_values, anchor_values=anchor_values)
    assert got == brute(rows, lambda i: i % 4 == 0)
    assert {r[2] for r in got} == {1, 2, 3, 4, 5}


@pytest.mark.parametrize("scale", [100.0, 1e5])
def test_large_scores_are_exact(spark, scale):
    rows = vectors(60, 5, 2, scale)
    assert run(spark, rows) == brute(rows, lambda i: i % 4 == 0)


def test_ties_fall_to_the_smaller_id_and_limits_belong_to_the_window(spark):
    rows = [(i, [1.0, 0.0], i % 2) for i in range(30)]
    rows += [(30 + i, [0.8, 0.0], 1) for i in range(10)] + [(50 + i, [0.796875, 0.0], 1) for i in range(10)]
    assert run(spark, rows) == brute(rows, lambda i: i % 4 == 0)


def test_zero_and_negative_scores(spark):
    rows = [(0, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [-1.0, 0.0], 0), (3, [0.0, 2.0], 1), (5, [-1.0, 0.0], 1)]
    assert run(spark, rows) == brute(rows, lambda i: i % 4 == 0) == {(0, 1, 1, 3, 0, 0)}


def test_rows_that_cannot_take_part(spark):
    rows = vectors(40, 4, 3)
    odd = [
        (100, None, 0), (104, [1.0, None, 1.0, 1.0], 0), (108, [float("nan")] * 4, 0), (112, [float("inf")] * 4, 1),
        (None, [9.0] * 4, 1), (116, [9.0] * 4, None), (120, [], 0), (124, [5.0], 1),
    ]
    rows += odd + rows[:7] + [(0, [7.0, 7.0, 7.0, 7.0], 2), (1, [0.0, 0.0, 0.0, 0.0], 0)]
    assert run(spark, rows) == brute(rows, lambda i: i % 4 == 0)


def test_relabelled_rows(spark):
    rows = vectors(60, 6, 4)
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    plain = [(i, v, (label + 1) % 10 if i % 7 == 0 else label) for i, v, label in rows]
    assert run(spark, rows, relabel=moved) == brute(plain, lambda i: i % 4 == 0)


def test_no_rows_and_no_partners(spark):
    assert run(spark, []) == set()
    assert run(spark, [(0, [1.0], 0)]) == set()
    assert run(spark, [(1, [1.0], 0), (2, [1.0], 1)]) == set()
