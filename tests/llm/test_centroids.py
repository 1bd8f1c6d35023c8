"""Integer k-means against a plain one."""

import hashlib
import math

import numpy as np
import pytest

from touchline.llm import centroids as ce

SCHEMA = "vec_id long, embedding array<float>, cluster int, v int, lead int, rest int"


def brute(rows, s):
    kept = [(i, [math.floor(s.scale * float(x)) for x in e]) for i, e in rows
            if e is not None and len(e) == s.dim and all(x is not None and math.isfinite(x) for x in e)]
    key = lambda r: (hashlib.sha256(f"{s.seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[0] or 0, r[1])
    cs = [list(v) for _, v in sorted(kept, key=key)[:s.k]]

    def assign(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cs))

    for _ in range(s.rounds):
        got = [assign(v)[1] for _, v in kept]
        new = [[math.floor(sum(col) // got.count(j)) for col in zip(*[v for (_, v), g in zip(kept, got) if g == j])]
               if j in got else c for j, c in enumerate(cs)]
        cs = new
    out = [(i, *assign(v)[::-1]) for i, v in kept]
    total = sum(d for _, _, d in out)
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cs]
    return sorted([(i, j, d, sum(y for _, c, y in out if c == j), total, sha[j]) for i, j, d in out], key=str)


def run(spark, rows, s):
    df = spark.createDataFrame([(i, None if e is None else [None if x is None else float(x) for x in e], 1, 2, 3, 4)
                                for i, e in rows], SCHEMA).repartition(3)
    got = ce.cluster(df, s)
    assert [t for _, t in got.dtypes] == ["bigint", "int", "bigint", "bigint", "bigint", "string", "int"]
    return got


def floats(x):
    return [(int(i), e.astype(np.float32).tolist()) for i, e in enumerate(x)]


@pytest.mark.parametrize("shape", ["blobs", "noise", "copies", "large"])
def test_equals_brute_force(spark, shape):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 12))
    if shape == "blobs":
        x = 3 * rng.normal(size=(7, 12))[rng.integers(0, 7, 300)] + 0.1 * x
    elif shape == "copies":  # two in three rows hold one vector, so first centroids coincide
        x[rng.random(300) < 0.66] = x[0]
    elif shape == "large":
        x = x * 20_000
    s = ce.Settings(k=7, rounds=5, dim=12, lead=4)
    got = run(spark, floats(x), s)
    assert sorted((tuple(r)[:6] for r in got.collect()), key=str) == brute(floats(x), s)
    if shape == "blobs":  # bounds spare most centroids
        assert got.agg({"checked": "avg"}).first()[0] < 3


def test_odd_rows(spark):
    s = ce.Settings(k=3, rounds=2, dim=2, lead=1)
    rows = [(1, None), (2, []), (3, [1.0]), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 0.0]),
            (7, [1.0, 2.0, 3.0]), (None, [0.5, 0.5]), (8, [0.5, 0.5]), (8, [0.5, 0.5]), (8, [-1.0, 2.0]), (9, [-0.001, 0.0])]
    assert sorted((tuple(r)[:6] for r in run(spark, rows, s).collect()), key=str) == brute(rows, s)
    assert sorted((tuple(r)[:6] for r in run(spark, rows[-1:], s).collect()), key=str) == brute(rows[-1:], s)
    for none in ([], rows[:7]):
        assert run(spark, none, s).collect() == []
    with pytest.raises(ValueError, match="components"):
        run(spark, [(1, [1e6, 0.0])], s)


def test_bound_never_exceeds_the_distance():
    rng = np.random.default_rng(8)
    v = rng.integers(-ce.MOST, ce.MOST, (500, 64))
    v[:250] //= 10_000
    q, _ = np.linalg.qr(rng.normal(size=(64, 64)))
    turn = ce.Rotation(v.mean(axis=0), q, 16)
    lead, rest = turn.place(v)
    c, d, _ = ce.nearest(v, lead, rest, v[::50].copy(), turn)
    want = [min((int(sum((a - b) ** 2 for a, b in zip(x, y))), j) for j, y in enumerate(v[::50].tolist())) for x in v.tolist()]
    assert list(zip(d.tolist(), c.tolist())) == want
