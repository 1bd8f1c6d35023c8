"""Top-k search against a brute force, on vectors of several shapes."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int, v int, id int"


def brute(rows, every=50, k=5):
    ok = [(i, np.floor(256 * np.array(e, np.float64)).astype(np.int64)) for i, e in rows
          if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for q, x in ok:
        if q % every == 0:
            s = sorted({(-int(x @ y), j) for j, y in ok if j != q})[:k]
            out += [(q, r + 1, j, -v) for r, (v, j) in enumerate(s)]
    return sorted(out)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, None if e is None else [None if x is None else float(x) for x in e], 1, 2, 3)
                                for i, e in rows], SCHEMA).repartition(3)
    got = topk.search(df, F.col("vec_id") % 50 == 0, topk.Settings(**kw))
    assert got.dtypes[:4] == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    return sorted(tuple(r) for r in got.collect())


@pytest.mark.parametrize("shape", ["clusters", "noise", "copies", "lengths"])
def test_equals_brute_force(spark, shape):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 8))
    if shape == "clusters":
        x = rng.normal(size=(6, 8))[rng.integers(0, 6, 400)] + 0.05 * x
    elif shape == "copies":  # a third of all rows hold one vector
        x[rng.random(400) < 0.35] = x[0]
    elif shape == "lengths":
        x *= rng.exponential(3.0, (400, 1))
    rows = [(int(i), e.astype(np.float32).tolist()) for i, e in enumerate(x)]
    assert run(spark, rows, pivots=8, rings=6, block=64, queries=3) == brute(rows)


def test_odd_rows(spark):
    rows = [(0, [1.0, 0.5]), (50, [0.0, 0.0]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]),
            (4, [float("inf"), 1.0]), (None, [1.0, 1.0]), (5, [1.0, 0.5]), (5, [1.0, 0.5]), (6, [-1.0, 2.0])]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []
    assert run(spark, [(0, [1.0])]) == []
    zero = [(i, [0.0, 0.0]) for i in range(120)]
    assert run(spark, zero) == brute(zero)
    shared = [(0, [1.0, 2.0]), (0, [3.0, 1.0]), (7, [1.0, 1.0]), (7, [2.0, 2.0])]
    got = run(spark, shared)
    assert got and all(r[2] == 7 for r in got)


def test_any_length_and_size(spark):
    """Shorter vectors go on with zeros; products beyond 2^53 stay exact; what may not fit a long raises."""
    def padded(rows):
        dim = max((len(e) for _, e in rows), default=0)
        return [(i, [*e, *[0.0] * (dim - len(e))]) for i, e in rows]
    rows = [(0, [1.0, 0.5]), (50, []), (1, [2.0]), (2, [0.5, 0.25, -3.0]), (3, []), (100, [0.0, 0.0, 1.0]), (4, [-1.0])]
    assert run(spark, rows) == brute(padded(rows))
    assert run(spark, [(0, []), (7, []), (8, [])]) == [(0, 1, 7, 0), (0, 2, 8, 0)]
    rng = np.random.default_rng(0)
    large = [(i, (rng.integers(-2**22, 2**22, 3) + rng.integers(0, 256, 3) / 256).astype(np.float32).tolist()) for i in range(200)]
    exact = [(i, [float(np.float32(x)) for x in e]) for i, e in large]
    want = []
    for q, x in exact:
        if q % 50 == 0:
            v = lambda e: [math.floor(256 * c) for c in e]
            s = sorted((-sum(a * b for a, b in zip(v(x), v(y))), j) for j, y in exact if j != q)[:5]
            want += [(q, r + 1, j, -t) for r, (t, j) in enumerate(s)]
    assert run(spark, large, pivots=4, rings=3) == sorted(want)
    with pytest.raises(ValueError, match="fit a long"):
        run(spark, [(0, [1e30, 1.0]), (1, [1.0, 1.0])])


def test_batches_of_queries(spark):
    rng = np.random.default_rng(6)
    rows = [(int(i), e.astype(np.float32).tolist()) for i, e in enumerate(rng.normal(size=(300, 4)))]
    got = topk.search(spark.createDataFrame([(i, e, 1, 2, 3) for i, e in rows], SCHEMA), F.col("vec_id") % 2 == 0,
                      topk.Settings(pivots=4, rings=4, block=32, batch=20))
    assert sorted(map(tuple, got.collect())) == brute(rows, every=2)
