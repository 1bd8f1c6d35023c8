"""SimHash components against a pair-by-pair brute force."""

from itertools import combinations

import numpy as np
import pytest
import xxhash

from touchline.llm import simhash


def brute_print(text, size=4, seed=42):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(words[i:i + size]), seed) for i in range(max(1, len(words) - size + 1))]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hs) > len(hs))


def brute_components(prints, bits=4):
    """Smallest id reachable of each (id, fingerprint) row."""
    fps = sorted({f for _, f in prints})
    up = {f: f for f in fps}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in combinations(fps, 2):
        if (a ^ b).bit_count() <= bits:
            up[find(a)] = find(b)
    low = {}
    for i, f in prints:
        if i is not None:
            low[find(f)] = min(i, low.get(find(f), i))
    return [low.get(find(f)) for _, f in prints]


def near_texts(n, seed=3):
    rng = np.random.default_rng(seed)
    vocab = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choice(vocab, rng.integers(3, 60))) for _ in range(n // 6)]
    out = list(base)
    while len(out) < n:
        words = base[rng.integers(0, len(base))].split()
        for _ in range(rng.integers(0, 3)):
            words[rng.integers(0, len(words))] = str(rng.choice(vocab))
        out.append(rng.choice(["  ", "\t", " "]).join(words))
    return out


def check(spark, df, s=simhash.Settings()):
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = simhash.near_duplicates(df, s)
    assert got.dtypes[:3] == [("doc_id", "bigint"), ("fingerprint", "string"), ("component_id", "bigint")]
    prints = [(i, brute_print(t)) for i, t in rows]
    want = [(i, f"{f:016x}", c, i is not None and i == c)
            for (i, f), c in zip(prints, brute_components(prints, s.bits), strict=True)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_texts(spark, make_docs, odd_texts):
    texts = [*near_texts(240), *odd_texts, "One two THREE four", "one  two three\nfour", "Ünïcode ÀÉ stays"]
    check(spark, make_docs(texts))
    check(spark, make_docs([(9, "a b"), (9, "a b"), (9, "c d e f g"), (None, "a b"), (None, "only here"), (2, None)]))


def test_empty_table(spark, make_docs):
    assert simhash.near_duplicates(make_docs([])).collect() == []


@pytest.mark.parametrize("width", [2, 3, 4])
def test_sets_cover_any_four_positions(width):
    sets = simhash.cover(width)
    assert len(sets) == {2: 7, 3: 20, 4: 70}[width]
    fours = [sum(1 << p for p in c) for c in combinations(range(8), 4)]
    assert all(any(f & a == a for a in sets) for f in fours)
    if width < 4:
        assert all(any(f & b == b for b in simhash.finer(a)) for a in sets for f in fours if f & a == a)


def test_shared_bytes():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 2000).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    x[:1000] &= rng.choice(np.array([0xFF00FF00FF00FF00, 0x00FFFF0000010080, 0, 0x80808000FF000001], np.uint64), 1000)
    assert simhash.shared_bytes(x).tolist() == [sum(b == 0 for b in int(v).to_bytes(8, "little")) for v in x]


def fingerprints_around(centres, per, flips, seed):
    rng = np.random.default_rng(seed)
    out = set()
    for c in rng.integers(0, 2**63, centres):
        for _ in range(per):
            v = int(c)
            for k in rng.choice(64, rng.integers(0, flips + 1), replace=False):
                v ^= 1 << int(k)
            out.add(v)
    return sorted(out)


@pytest.mark.parametrize("meet,mean,flips", [(4096, 64, 3), (8, 64, 2), (8, 1e-4, 3), (20, 1e-9, 6)])
def test_links_of_any_list_length(spark, meet, mean, flips):
    """Short lists, lists posted under further positions, and pairs of blocks."""
    from touchline.llm import graph
    fps = fingerprints_around(6, 60, flips, 11)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    entries = spark.createDataFrame([(f,) for f in signed], "fp long").repartition(3)
    roots = {r.node: r.root for r in graph.components(
        simhash.links(entries, simhash.Settings(meet=meet, mean_list=mean))).collect()}
    got = {}
    for f in signed:
        got.setdefault(roots.get(f, f), set()).add(f)
    want = {}
    for f, c in zip(signed, brute_components(list(enumerate(fps))), strict=True):
        want.setdefault(c, set()).add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
