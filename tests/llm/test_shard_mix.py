"""Sharding and mixing: limits, conservation, repeatability."""

import math
import random
from collections import defaultdict

import pytest

from touchline.llm import mixing, shard


def texts(n, seed=1, most=400):
    rng = random.Random(seed)
    return [" ".join("w" * rng.randrange(1, 9) for _ in range(rng.randrange(most))) for _ in range(n)]


def check_shards(rows, limit):
    per = defaultdict(lambda: [0, 0, set()])
    for r in rows:
        b = len((r.text or "").encode())
        per[r.shard][0] += b
        per[r.shard][1] += 1
        per[r.shard][2].add(r.shard_bytes)
    for s, (b, n, stated) in per.items():
        assert stated == {b} and (b <= limit or n == 1), (s, b, n)
    names = sorted(per)
    assert all(not b.startswith(a) for a in names for b in names if a != b)
    totals = lambda p: sum(v[0] for k, v in per.items() if k.startswith(p))
    for s in names:  # only oversized buckets split: every parent is too large
        if s:
            assert totals(s[:-1]) > limit
    return per


@pytest.mark.parametrize("limit", [500, 5_000, 10**9])
def test_shards_fit_and_split_only_when_needed(make_docs, limit):
    docs = make_docs(texts(150))
    got = shard.shards(docs, limit)
    assert set(got.columns) == {*docs.columns, "shard", "shard_depth", "shard_bytes"}
    rows = got.collect()
    assert sorted(r.doc_id for r in rows) == list(range(150))
    per = check_shards(rows, limit)
    assert (len(per) == 1) == (limit == 10**9)


def test_shards_of_odd_rows(make_docs, odd_texts):
    rows = shard.shards(make_docs(odd_texts), 100).collect()
    assert len(rows) == len(odd_texts)
    check_shards(rows, 100)
    assert shard.shards(make_docs([]), 100).count() == 0
    same = shard.shards(make_docs([(3, "ten bytes!")] * 40 + [(None, "x" * 10)] * 5), 60).collect()
    assert len(same) == 45
    check_shards(same, 60)  # whole rows that repeat are told apart


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, open_, out = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        total = sum(w[s] for s in open_)
        share = {s: left * w[s] / total for s in open_}
        above = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not above:
            out |= share
            break
        for s in above:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= above
    return out


def test_mix_meets_targets_and_repeats(make_docs):
    docs = make_docs(texts(400, 2), sources=("b", "a", None, "ü", "z"))
    one = {r.doc_id: r for r in mixing.mix(docs).collect()}
    src = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
    sizes, taken = defaultdict(int), defaultdict(int)
    for i, r in one.items():
        sizes[src[i]] += r["size"]
        taken[src[i]] += r.taken
        assert r.taken == r.copies * r["size"] and 0 <= r.copies <= 2
    goal = brute_targets(sizes)
    longest = max(r["size"] for r in one.values())
    for i, r in one.items():
        assert r.source_size == sizes[src[i]] and math.isclose(r.target, goal[src[i]], rel_tol=1e-9)
    for s in sizes:
        assert abs(taken[s] - goal[s]) <= longest
    again = {r.doc_id: r.taken for r in mixing.mix(docs.repartition(7)).collect()}
    assert again == {i: r.taken for i, r in one.items()}


def test_mix_tree_of_several_levels(make_docs, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP", 8)
    monkeypatch.setattr(mixing, "FAN", 3)
    docs = make_docs(texts(300, 5, 60), sources=("a", "b"))
    rows = mixing.mix(docs).collect()
    assert len(rows) == 300
    src = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
    for s in "ab":
        own = [r for r in rows if src[r.doc_id] == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 60


def test_mix_of_odd_rows(make_docs, odd_texts):
    docs = make_docs(odd_texts + [(0, "a b")] * 3)
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(odd_texts) + 3
    assert all(r.taken == 0 for r in rows if r["size"] == 0)
    assert mixing.mix(make_docs([])).count() == 0
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    assert sum(len((r.text or "").split()) for r in out.collect()) == sum(r.taken for r in rows)


def test_equal_rows_share_their_copies(make_docs):
    docs = make_docs([(1, "a b c d")] * 50 + [(2, "x " * 30)], sources=("s",))
    rows = mixing.mix(docs).collect()
    same = [r.copies for r in rows if r.doc_id == 1]
    assert len(same) == 50 and abs(sum(same) - 75) <= 8  # 150 % of 50 copies, but for the one long row


def test_pivot_keeps_sums_and_expectations():
    import numpy as np
    rng = np.random.default_rng(0)
    size = rng.integers(1, 50, 40)
    part = np.full(40, 0.3)
    total = np.zeros(40)
    for _ in range(3000):
        p = mixing.pivot(size, part, rng.random(40))
        assert math.isclose((p * size).sum(), (part * size).sum(), rel_tol=1e-9)
        assert ((p > 0) & (p < 1)).sum() <= 1
        total += p
    assert np.abs(total / 3000 - 0.3).max() < 0.05
