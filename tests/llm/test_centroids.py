"""Clusters equal a plain computation in whole numbers, for small, large and huge components and awkward rows."""

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from freightlens.llm import centroids as C

SCHEMA = "vec_id long, embedding array<double>, cluster string, key int"


def brute(rows, k, rounds, dims):
    kept = [(i, [math.floor(Fraction(v) * 1024) for v in x]) for i, x in rows if x and len(x) == dims and all(v is not None and math.isfinite(v) for v in x)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    means = [x for _, x in order[:k]]

    def near(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), n) for n, c in enumerate(means))

    for _ in range(rounds):
        groups = [[] for _ in means]
        for _, x in kept:
            groups[near(x)[1]].append(x)
        means = [[sum(col) // len(g) for col in zip(*g)] if g else c for g, c in zip(groups, means)]
    found = [(i, *near(x)[::-1]) for i, x in kept]
    inertia = [sum(d for _, n, d in found if n == c) for c in range(len(means))]

    def long(v):
        return v if v < 2**63 else None

    return sorted(((i, n, long(d), long(inertia[n]), long(sum(inertia)), hashlib.sha256(",".join(map(str, means[n])).encode()).hexdigest()) for i, n, d in found), key=repr)


@pytest.mark.parametrize("size", [1, 3000, 1e7, 1e13, 1e30])
def test_equal_to_whole_numbers(spark, size):
    r = random.Random(size)
    rows = [(i, [r.uniform(-size, size) for _ in range(4)]) for i in range(120)]
    rows += [(3, rows[3][1]), (None, [1.5] * 4), (200, [2.0 * size, 0.0, 1e-9, -1e-9])] + [(300 + i, [1.0, 2.0, 3.0, 4.0]) for i in range(30)]  # repeats, a null id, ties
    rows += [(400, None), (401, []), (402, [1.0] * 3), (403, [1.0, None, 1.0, 1.0]), (404, [1.0, math.nan, 1.0, 1.0]), (405, [1.0, math.inf, 1.0, -math.inf])]
    df = spark.createDataFrame([(i, x, "clash", 1) for i, x in rows], SCHEMA).repartition(5)
    found = C.cluster(df, clusters=5, rounds=4, dimensions=4).collect()
    assert sorted((tuple(x) for x in found), key=repr) == brute(rows, 5, 4, 4)


def test_bounds_of_the_product():
    """Rows just below and above the bound of float64 have the distances of whole numbers."""
    r = random.Random(1)
    rows = np.array([[r.randrange(-(1 << b), 1 << b) for _ in range(64)] for b in range(1, 60)], dtype=np.int64)
    for most in (1, 1 << 20, 1 << 23, 1 << 30, 1 << 40):
        c = C.Centroids(tuple(tuple(r.randrange(-most, most) for _ in range(64)) for _ in range(8)))
        cluster, distance = C.nearest(rows, c)
        plain = [min((sum((int(a) - b) ** 2 for a, b in zip(row, centre)), n) for n, centre in enumerate(c.rows)) for row in rows]
        assert list(zip([int(d) for d in distance], cluster.tolist())) == plain


def test_few_and_no_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], "x", 1), (2, [1.0, 2.0], "x", 1)], SCHEMA)
    assert [(x.vec_id, x.cluster, x.distance) for x in C.cluster(df, dimensions=2).orderBy("vec_id").collect()] == [(1, 0, 0), (2, 0, 0)]
    assert C.cluster(df.where(F.lit(False)), dimensions=2).count() == 0
    assert C.cluster(df, dimensions=3).count() == 0


def test_floors_are_exact():
    assert C.whole(np.array([-1e-12, 0.0, 0.9999999, -2.5, 1e300, 2.0**60 + 512]), 1024).tolist() == [-1, 0, 1023, -2560, int(1e300) * 1024, (2**60 + 512) * 1024]
