"""Context-tree weighting against a direct recursion, and the base scores."""

import collections
import math
import random
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from touchline.llm import ctw
from touchline.llm import textkit as tk


def log_kt(a, b):
    p = 0.0
    for i in range(a):
        p += math.log((i + 0.5) / (i + 1))
    for i in range(b):
        p += math.log((i + 0.5) / (a + i + 1))
    return p


class Brute:
    """The tree as nested recursion over contexts (most recent byte first)."""

    def __init__(self, train, depth):
        self.depth, self.counts, self.children = depth, collections.defaultdict(lambda: [0, 0]), collections.defaultdict(set)
        for t in train:
            x = bytes([255]) * depth + t + bytes([255])
            for i in range(depth, len(x)):
                for j in range(8):
                    node, bit = (1 << j) | (x[i] >> (8 - j)), (x[i] >> (7 - j)) & 1
                    for d in range(depth + 1):
                        ctx = x[i - d:i]
                        self.counts[(ctx, node)][bit] += 1
                        if d < depth:
                            self.children[(ctx, node)].add(x[i - d - 1:i])
        self.weighted = lru_cache(None)(self._weighted)

    def _weighted(self, ctx, node):
        own = log_kt(*self.counts.get((ctx, node), (0, 0)))
        if len(ctx) == self.depth:
            return own
        below = sum(self.weighted(c, node) for c in self.children.get((ctx, node), ()))
        return np.logaddexp(own, below) - math.log(2)

    def one(self, ctx, node, d=0):
        """Chance of a one after the whole context ``ctx``."""
        at = ctx[len(ctx) - d:]
        n0, n1 = self.counts.get((at, node), (0, 0))
        kt = (n1 + 0.5) / (n0 + n1 + 1)
        if d == self.depth:
            return kt
        lam = math.exp(log_kt(n0, n1) - math.log(2) - self.weighted(at, node))
        return lam * kt + (1 - lam) * self.one(ctx, node, d + 1)

    def log2(self, t):
        x = bytes([255]) * self.depth + t + bytes([255])
        out = 0.0
        for i in range(self.depth, len(x)):
            for j in range(8):
                p = self.one(x[i - self.depth:i], (1 << j) | (x[i] >> (8 - j)))
                out += math.log2(p if (x[i] >> (7 - j)) & 1 else 1 - p)
        return out


def texts(n=14):
    rng = random.Random(3)
    return ["".join(rng.choice("ab é") for _ in range(rng.randrange(25))) for _ in range(n)] + ["", None, "abab"]


def run(docs, **kw):
    held = tk.id_remainder("doc_id", 5) == 1
    return ctw.scores(docs, held, ctw.Settings(**kw))


def test_scores_equal_the_recursion(make_docs):
    rows = texts()
    out = run(make_docs(rows), depth=4, split=2, subtree_rows=10, block_bytes=40).collect()
    low = [(t or "").lower().encode() for t in rows]
    held = {r.doc_id: r.held_out for r in out}
    assert {True, False} == set(held.values())
    model = Brute([t for i, t in enumerate(low) if not held[i]], 4)
    train = [t for i, t in enumerate(low) if not held[i]]
    c = collections.Counter(w for t in train for w in t.split())
    n, v = sum(c.values()) + len(train), len(c) + 1
    prob = lambda k: math.log10((k + 0.5) / (n + 0.5 * (v + 1)))
    assert len(out) == len(rows)
    for r in out:
        t = low[r.doc_id]
        assert math.isclose(r.score, model.log2(t) * math.log10(2), rel_tol=1e-9)
        assert math.isclose(r.bits_per_byte, -model.log2(t) / (len(t) + 1), rel_tol=1e-9)
        assert math.isclose(r.base_score, sum(prob(c[w]) for w in t.split()) + prob(len(train)), rel_tol=1e-12)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t.split()) + 1, sum(c[w] > 0 for w in t.split()) + 1, n)


def test_blocks_and_subtrees_do_not_change_scores(make_docs):
    rows = texts(40)
    a = {r.doc_id: r.score for r in run(make_docs(rows)).collect()}
    b = {r.doc_id: r.score for r in run(make_docs(rows, partitions=5), block_bytes=64, subtree_rows=3).collect()}
    assert all(math.isclose(a[i], b[i], rel_tol=1e-9) for i in a)


def test_chances_of_all_bytes_sum_to_one():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 4, (300, 3)) @ np.array([65536, 256, 1])).astype(np.uint64)
    ctx = keys[0] >> np.uint64(8)
    every = (ctx << np.uint64(8)) | np.arange(256, dtype=np.uint64)
    full = np.unique(np.concatenate([keys, every]))
    n = np.where(np.isin(full, keys), rng.integers(1, 9, len(full)), 0)
    # all 255 nodes of the root, with the whole weight on the deeper levels
    ids = np.arange(256, dtype=np.int64)
    bits = ctw.code_lengths(full, n, (ids, np.zeros(256), np.ones(256)), 2, 0)
    assert math.isclose((2 ** bits[np.isin(full, every)]).sum(), 1.0, rel_tol=1e-9)


def test_lookup_and_strings():
    rng = np.random.default_rng(2)
    k = np.unique(rng.integers(0, 2**63, 5000, dtype=np.uint64))
    t = ctw.Lookup(k, np.arange(len(k)).astype(float))
    assert np.array_equal(t.get(k[::-1].copy(), -1), np.arange(len(k))[::-1])
    assert (t.get(k + np.uint64(1), -1)[~np.isin(k + np.uint64(1), k)] == -1).all()
    data, offs = tk.buffers(pa.array(["ab", "", "c"]))
    s, o = ctw.strings(data, offs, 2)
    e = "ff"
    assert [f"{x:06x}" for x in s.tolist()] == [e + e + "61", e + "6162", "6162" + e, e * 3, e + e + "63", e + "63" + e]
    assert o.tolist() == [0, 3, 4, 6]


def test_odd_rows(make_docs, odd_texts):
    rows = [(i, t) for i, t in enumerate(odd_texts)] + [(None, "no id at all"), (3, "word")]
    out = run(make_docs(rows)).collect()
    assert len(out) == len(rows) and all(r.score < 0 and r.base_score < 0 for r in out)
    assert len({r.score for r in out if r.doc_id == 3}) == 1
    assert run(make_docs([])).count() == 0
    none = run(make_docs([(1, "ab")]).withColumn("doc_id", F.lit(11).cast("long"))).collect()  # 11 is held out
    if none[0].held_out:
        assert none[0].train_tokens == 0 and math.isclose(none[0].score, 3 * -8 * math.log10(2), rel_tol=1e-9)
