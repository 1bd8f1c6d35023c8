"""The filter audit against applying the filters one by one."""

import re
from itertools import permutations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.llm import audit


def failures(i, text, ids_of):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = ""
    out += "A" if len(words) < 100 else ""
    out += "B" if 100 * len(set(words)) < 80 * len(words) else ""
    out += "C" if 100 * len(re.findall("[A-Z]", text)) > 10 * len(text) else ""
    out += "D" if re.search(r"[#$%&*|]", text) else ""
    out += "E" if i is not None and any(j is not None and j < i for j in ids_of[text]) else ""
    return out


def brute(rows, labels):
    """rows: (id, text, lang); labels: (id, quality, toxic)."""
    ids_of = {}
    for i, t, _ in rows:
        ids_of.setdefault(t or "", []).append(i)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    parts = {}
    for i, t, lang in rows:
        parts.setdefault(lang or "", []).append((failures(i, t or "", ids_of), i in good, i in toxic))
    out = []
    for part, docs in parts.items():
        rows_, shapley = [], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = docs
            for k, f in enumerate(order):
                gone = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                shapley[f] += len(gone)
                early = sum(f in d[0] and any(g in d[0] for g in order[:k]) for d in docs)
                rows_.append((part, "".join(order), k + 1, len(left), len(gone), early, sum(d[0] == f for d in docs),
                              sum(d[1] for d in gone), sum(d[2] for d in gone)))
        out += [(*r, shapley[r[1][r[2] - 1]]) for r in rows_]
    return sorted(out)


def run(spark, docs, labels):
    lab = spark.createDataFrame([(*x, 9) for x in labels], "doc_id long, quality int, toxic int, n int")
    got = audit.interactions(docs, lab)
    assert got.columns[:3] == ["part", "filter_order", "step"]
    return sorted(map(tuple, got.collect()))


def test_texts(spark, make_docs, odd_texts):
    rng = np.random.default_rng(2)
    vocab = ["plain", "Word", "UPPER", "x#y", "é", "50%", *[f"w{i}" for i in range(400)]]
    texts = [" ".join(rng.choice(vocab[:rng.integers(3, 400)], rng.integers(1, 160))) for _ in range(120)]
    rows = list(enumerate([*texts, *texts[:50], *odd_texts])) + [(3, texts[3]), (3, texts[9]), (None, texts[3]), (None, "only")]
    docs = make_docs(rows).withColumn("lang", F.when(F.col("lang").isNull(), F.col("lang")).otherwise(
        F.element_at(F.array(F.lit("en"), F.lit("de"), F.lit("")), (F.pmod(F.hash("text"), F.lit(3)) + 1).cast("int"))))
    docs = docs.withColumns({c: F.lit(3) for c in ("part", "mask", "n", "good", "toxic", "fails", "text_key", "marked", "first")})
    labels = [(i, int(rng.integers(0, 2)), int(rng.integers(0, 2))) for i in range(0, 150, 2)]
    labels += [(4, 1, 0), (4, 0, 1), (6, None, None), (None, 1, 1), (9999, 1, 1)]
    seen = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    want = brute(seen, labels)
    assert len(want) == 600 * 3
    assert run(spark, docs, labels) == want
    assert run(spark, docs, []) == brute(seen, [])


def test_empty_tables(spark, make_docs):
    assert run(spark, make_docs([]), []) == []
    assert len(run(spark, make_docs([None]), [(0, 1, 1)])) == 600


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5])
def test_swaps_reach_every_order(n):
    names = "ABCDE"[:n]
    order, seen = list(names), {names}
    for at in audit.neighbouring_orders(n):
        order[at:at + 2] = order[at + 1], order[at]
        seen.add("".join(order))
    assert len(seen) == factorial(n)
    assert sum(1 for _ in audit.neighbouring_orders(n)) == factorial(n) - 1


def test_diagram_after_swaps():
    """Every order's diagram weighs as the one built for that order."""
    rng = np.random.default_rng(5)
    counts = {m: tuple(int(x) for x in rng.integers(0, 4, 3)) for m in range(32) if rng.random() < 0.6}
    d = audit.Diagram("ABCDE", counts)
    for at in [0, 1, 3, 2, 0, 3, 1, 2, 2, 0]:
        d.swap(at)
        place = {f: i for i, f in enumerate("ABCDE")}
        passed = 0
        for f, kept, removed in d.steps():
            gone = [w for m, w in counts.items() if not m & passed and m >> place[f] & 1]
            passed |= 1 << place[f]
            left = [w for m, w in counts.items() if not m & passed]
            assert kept == tuple(map(sum, zip((0, 0, 0), *left))) and removed == tuple(map(sum, zip((0, 0, 0), *gone)))
    assert len(d.below) < 2000
