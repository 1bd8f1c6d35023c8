"""Decontamination: exact and edited passages, and clean documents."""

import random

import numpy as np
import pyarrow as pa
import pytest

from touchline.llm import decontam as dc
from touchline.llm import textkit as tk


def vocabulary(rng, n=3000):
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(n)]


@pytest.fixture(scope="module")
def case():
    rng = random.Random(11)
    v = vocabulary(rng)
    common = v[:40]
    text = lambda n: [rng.choice(common) if rng.random() < 0.5 else rng.choice(v) for _ in range(n)]
    items = [" ".join(text(rng.randrange(15, 60))) for _ in range(60)]
    return rng, v, text, items


def edit(rng, v, w, k):
    w = list(w)
    for _ in range(k):
        op, p = rng.choice("sid"), rng.randrange(len(w))
        if op == "s":
            w[p] = rng.choice(v)
        elif op == "i":
            w.insert(p, rng.choice(v))
        else:
            w.pop(p)
    return w


def brute(texts, items, rate=0.2):
    """All (document, item) pairs within the edits, by plain dynamic programming."""
    norm = lambda t: ["".join(c for c in w if c.isalnum() or ord(c) > 127) for w in (t or "").lower().split()]
    out = set()
    for d, t in enumerate(texts):
        x = [w for w in norm(t) if w]
        for q, it in enumerate(items):
            y = [w for w in norm(it) if w]
            if len(y) < 5:
                continue
            row = [0] * (len(x) + 1)
            for i, w in enumerate(y):
                new = [i + 1]
                for j, u in enumerate(x):
                    new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (u != w)))
                row = new
            if min(row) <= int(rate * len(y)):
                out.add((d, q))
    return out


def test_finds_what_brute_force_finds(spark, make_docs, case):
    rng, v, text, items = case
    texts = [" ".join(text(rng.randrange(0, 150))) for _ in range(40)]
    for k in range(40):
        i = k % len(items)
        w = edit(rng, v, items[i].split(), int(rng.random() * 0.2 * len(items[i].split())))
        a, b = text(rng.randrange(60)), text(rng.randrange(60))
        texts.append(" ".join(a + w + b))
    texts.append(items[3].upper().replace(" ", " , "))
    bench = spark.createDataFrame([(i, t, "x") for i, t in enumerate(items)], "item_id long, text string, edits string")
    want = brute(texts, items)
    got = {(r.doc_id, r.item_id) for r in dc.contaminated(make_docs(texts), bench).collect()}
    assert got <= want and len(got) >= 0.97 * len(want) and len(want) >= 35
    clean = dc.clean(make_docs(texts), bench)
    assert {r.doc_id for r in clean.collect()} == set(range(len(texts))) - {d for d, _ in got}


def test_recall_at_every_rate(case):
    rng, v, text, items = case
    s = dc.Settings()
    bench = dc.Bench(list(range(len(items))), items, s)
    for rate in (0.0, 0.1, 0.2):
        texts = []
        for i, it in enumerate(items):
            w = it.split()
            texts.append(" ".join(text(20) + edit(rng, v, w, int(rate * len(w))) + text(20)))
        found = set()
        for lo, _, data, offs in tk.documents(pa.array(texts)):
            found |= {(lo + d, q) for d, q in bench.find(*dc.words(data, offs), s)}
        assert sum((i, i) in found for i in range(len(items))) >= (1.0 if rate == 0 else 0.95) * len(items)


def test_edits_equal_plain_programming():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a, b = rng.integers(0, 4, rng.integers(1, 9)), rng.integers(0, 4, rng.integers(0, 14))
        row = [0] * (len(b) + 1)
        for i, w in enumerate(a):
            new = [i + 1]
            for j, u in enumerate(b):
                new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (u != w)))
            row = new
        assert dc.edits(a.astype(np.uint64), b.astype(np.uint64)) == min(row)


def test_benchmark_in_blocks_and_odd_rows(spark, make_docs, case, odd_texts):
    _, _, text, items = case
    rows = [(i, t) for i, t in enumerate(items)] + [(90, None), (91, ""), (92, "not there"), (None, items[0])]
    bench = spark.createDataFrame(rows, "item_id long, text string")
    docs = make_docs([*odd_texts, items[5], items[5], (None, items[7])] if False else
                     [(i, t) for i, t in enumerate(odd_texts)] + [(50, items[5]), (50, items[5]), (None, items[7])])
    small = dc.Settings(block_bytes=1500)
    got = sorted(((r.doc_id, r.item_id, r.edits) for r in dc.contaminated(docs, bench, small).collect()), key=str)
    assert got == sorted([(50, 5, 0), (None, 7, 0)], key=str)
    kept = dc.clean(docs, bench, small)
    assert kept.columns == docs.columns and kept.count() == len(odd_texts)
    assert dc.contaminated(make_docs([]), bench).count() == 0
    assert dc.contaminated(docs, bench.limit(0)).count() == 0 and dc.clean(docs, bench.limit(0)).count() == docs.count()


def test_items_of_any_length(spark, make_docs):
    """Items of one to four words are found as they are, one of thousands of words with edits."""
    rng = random.Random(5)
    v = [f"w{i}" for i in range(4000)]
    long = [rng.choice(v) for _ in range(5000)]
    items = ["Zebra", "only two", "three little words", "now four short words", " ".join(long)]
    filler = lambda n: [rng.choice(v) for _ in range(n)]
    texts = {0: " ".join([*filler(30), "zebra,", *filler(30)]), 1: "zebras only three little word now four short",
             2: " ".join([*filler(9), "Only", "two"]), 3: "three  little\nwords", 4: "x now four short words y",
             5: " ".join([*filler(200), *edit(rng, v, long, 700), *filler(200)]), 6: " ".join(filler(6000)),
             7: " ".join([*long[:3500], *filler(1500)]), 8: "two only little three words"}
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = make_docs(list(texts.items()))
    got = sorted((r.doc_id, r.item_id, r.item_words) for r in dc.contaminated(docs, bench).collect())
    assert got == [(0, 0, 1), (2, 1, 2), (3, 2, 3), (4, 3, 4), (5, 4, 5000)]
    assert {r.doc_id for r in dc.clean(docs, bench).collect()} == {1, 6, 7, 8}
    held = dc.Settings(min_words=5)
    assert {r.doc_id for r in dc.contaminated(docs, bench, held).collect()} == {5}
