"""Toxicity and quality: held-out accuracy and odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_MID
from touchline.llm import quality, toxicity
from touchline.llm import textkit as tk
from touchline.llm import train


def auc(y, s):
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    rank[order] = np.arange(len(s))
    pos = y.sum()
    return (rank[y == 1].sum() - pos * (pos - 1) / 2) / (pos * (len(y) - pos))


@pytest.mark.parametrize("op, label, held", [(toxicity.toxicity, "toxic", (5, 0)), (quality.quality, "quality", (3, 1))])
def test_held_out_accuracy(spark, op, label, held):
    docs, labels = tk.table(spark, SF_MID, "documents"), tk.table(spark, SF_MID, "labels")
    out = op(docs, labels, tk.id_remainder("doc_id", held[0]) == held[1]).join(labels, "doc_id").toPandas()
    test = out[out.held_out]
    assert out.score.between(0, 1).all() and ((out.score >= 0.5) == (out.predicted == 1)).all()
    assert (test.predicted == test[label]).mean() >= 0.93
    assert auc(test[label].to_numpy(), test.score.to_numpy()) >= 0.95


@pytest.mark.parametrize("op, label", [(toxicity.toxicity, "toxic"), (quality.quality, "quality")])
def test_labels_of_held_out_rows_do_not_matter(spark, op, label):
    docs, labels = tk.table(spark, SF_MID, "documents"), tk.table(spark, SF_MID, "labels")
    held = tk.id_remainder("doc_id", 5) == 0
    flipped = labels.withColumn(label, F.when(held, 1 - F.col(label)).otherwise(F.col(label)))
    a = {r.doc_id: r.score for r in op(docs, labels, held).collect()}
    b = {r.doc_id: r.score for r in op(docs, flipped, held).collect()}
    assert a == b


@pytest.mark.parametrize("op, label", [(toxicity.toxicity, "toxic"), (quality.quality, "quality")])
def test_odd_rows(spark, make_docs, odd_texts, op, label):
    docs = make_docs(odd_texts + [(None, "no id"), (2, "   \n")])
    labels = spark.createDataFrame([(i, i % 2, 1 - i % 2, "x") for i in range(len(odd_texts))] + [(None, 1, 1, "x")],
                                   "doc_id long, quality int, toxic int, text string")
    held = tk.id_remainder("doc_id", 5) == 0
    out = op(docs, labels, held).collect()
    assert len(out) == len(odd_texts) + 2 and all(0 <= r.score <= 1 for r in out)
    by = {}
    for r in out:
        by.setdefault(r.doc_id, set()).add(r.score)
    assert len(by[2]) == 1
    assert op(make_docs([]), labels, held).count() == 0
    none = op(docs, labels.limit(0), held).collect()
    assert {r.score for r in none} == {0.5}
    one = op(docs, labels.where(F.col(label) == 1), held).collect()
    assert len({r.score for r in one}) == 1 and one[0].score > 0.5


def test_sample_skips_texts_that_do_not_fit(spark, make_docs):
    """Long texts anywhere in hash order do not end the sample."""
    order = [r.id for r in spark.range(120).orderBy(F.xxhash64(F.col("id"), F.lit(7))).collect()]
    size = {i: 10 for i in order} | {order[0]: 5000, order[7]: 5000, order[8]: 900}
    docs = make_docs([(i, "a" * n) for i, n in size.items()])
    labels = spark.createDataFrame([(i, 1) for i in order], "doc_id long, toxic int")

    def ids(per_class, max_bytes):
        known = train.labelled(docs, labels, "toxic", F.lit(True))
        rows, totals = train.sample(docs, known, "toxic", F.lit(True), per_class, max_bytes, ["text"])
        assert totals == {1: 120}
        return set(rows["doc_id"])
    assert ids(50, 4000) == set(order[1:7] + order[8:52])
    assert ids(50, 930) == set(order[1:7] + order[9:53])
    assert ids(200, 600) == set(order[1:7] + order[9:63])
    assert ids(200, 1 << 20) == set(order)
    with pytest.raises(ValueError, match="only 5 of 120"):
        ids(50, 50)


def test_interactions_in_linear_time_equal_all_pairs():
    rng = np.random.default_rng(1)
    model = {"b": 0.3, "w": rng.normal(size=20), "v": rng.normal(size=(20, 3))}
    x = rng.normal(size=(6, 20)) * (rng.random((6, 20)) < 0.4)
    cols, vals, offs = [], [], [0]
    for row in x:
        c = np.flatnonzero(row)
        cols += c.tolist()
        vals += row[c].tolist()
        offs.append(len(cols))
    got = quality.margin(model, np.array(cols, int), np.array(vals), np.array(offs))
    want = [0.3 + row @ model["w"] + sum(model["v"][i] @ model["v"][j] * row[i] * row[j]
                                         for i in range(20) for j in range(i)) for row in x]
    assert np.allclose(got, want)


def test_keep_good_keeps_rows_and_columns(spark, make_docs):
    docs, labels = tk.table(spark, SF_MID, "documents"), tk.table(spark, SF_MID, "labels")
    train = tk.id_remainder("doc_id", 3) != 1
    kept = quality.keep_good(docs, labels, train)
    assert kept.schema == docs.schema
    want = {r.doc_id for r in quality.quality(docs, labels, ~train).where("predicted = 1").collect()}
    assert {r.doc_id for r in kept.collect()} == want
    assert quality.keep_good(make_docs([]), labels, train).count() == 0


def test_repeated_rows_are_one_in_the_sample(spark, make_docs):
    """An id early in hash order that is repeated thousands of times is one row, and is fetched once."""
    order = [r.id for r in spark.range(400).orderBy(F.xxhash64(F.col("id"), F.lit(7))).collect()]
    rows = [(order[0], "hot row")] * 3000 + [(order[1], "short"), (order[1], "a longer text of the same id")] + \
        [(i, f"text {i}") for i in order[2:]]
    docs = make_docs(rows)
    labels = spark.createDataFrame([(i, k % 2) for k, i in enumerate(order)], "doc_id long, toxic int")
    known = train.labelled(docs, labels, "toxic", F.lit(True))
    assert known.count() == 400 and known.where(F.col("id") == order[0]).first().copies == 3000
    got, totals = train.sample(docs, known, "toxic", F.lit(True), 50, 1 << 20, ["text"])
    assert totals == {0: 200, 1: 200}
    assert sorted(got["doc_id"]) == sorted(order[:100]) and got["doc_id"].is_unique
    assert dict(zip(got["doc_id"], got["text"]))[order[1]] == "short"


def plain_grams(text, s):
    """Distinct n-grams of a text, by letters."""
    data = " ".join(t for t in [text.lower()]).encode()
    out, last = bytearray(), None
    for b in data:
        b = 32 if b in b" \t\n\v\f\r" else b
        if not (b == 32 and last == 32):
            out.append(b)
        last = b
    return {bytes(out[i:i + n]) for n in s.orders for i in range(len(out) - n + 1)}


def test_ratios_equal_brute_force(spark, make_docs):
    """Counted over all labelled training texts, far more than the sample holds; repeats of a row count once."""
    rng = np.random.default_rng(3)
    words = ["bad", "good", "Vile", "tree", "sun  set", "x\ty", "été"]
    texts = [" ".join(rng.choice(words, rng.integers(0, 6))) for _ in range(300)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(5, texts[5])] * 40 + [(7, None), (None, "bad bad")]
    docs = make_docs(rows)
    y = [int("bad" in t or "Vile" in t) for t in texts]
    labels = spark.createDataFrame([(i, 0, v) for i, v in enumerate(y)], "doc_id long, quality int, toxic int")
    held = tk.id_remainder("doc_id", 5) == 0
    s = toxicity.Settings(bits=18)
    known = train.labelled(docs, labels, "toxic", ~held)
    n = toxicity.counts(docs, known, ~held, s)
    kept = {r.id for r in known.collect()}
    texts[7] = "" if 7 in kept else texts[7]  # the shortest text of an id
    want = np.zeros((2, 1 << s.bits))
    for i in kept:
        for g in plain_grams(texts[i], s):
            at, _ = toxicity.grams(np.frombuffer(g, np.uint8), np.array([0, len(g)]), toxicity.Settings(orders=(len(g),)))
            want[y[i], at] += 1
    assert np.array_equal(n, want)
    totals = {c: sum(y[i] == c for i in kept) for c in (0, 1)}
    r = toxicity.ratios(n, totals, s)
    k = int(np.argmax(n[1]))
    assert r[k] == pytest.approx(np.log((n[1, k] + 1) / (totals[1] + 2) / ((n[0, k] + 1) / (totals[0] + 2))))
    assert (r[n.sum(axis=0) < 3] == 0).all()


def test_small_fit_lowers_the_plain_loss():
    """The fitted weights beat small changes of any of them, under the loss written out."""
    texts = ["bad tree", "bad sun", "vile bad", "good tree", "good sun", "tree sun", "bad", "good"] * 3
    y = np.array([1, 1, 1, 0, 0, 0, 1, 0] * 3, float)
    s = toxicity.Settings(bits=12, steps=3000, ridge=1e-2)
    n = np.zeros((2, 1 << s.bits))
    feats = []
    for t, c in zip(texts, y):
        i, _ = toxicity.grams(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]), s)
        n[int(c), i] += 1
        feats.append(i)
    totals = {0: 12, 1: 12}
    r = toxicity.ratios(n, totals, s)
    w, b = toxicity.fit(texts, y, totals, r, s)

    def loss(w, b):
        z = np.array([w[i].sum() + b for i in feats])
        v = np.where(r != 0, w / np.where(r == 0, 1, r), 0)
        return np.mean(np.log1p(np.exp(-np.where(y > 0, z, -z)))) + 0.5 * s.ridge * (v**2).sum()

    best = loss(w, b)
    for k in np.flatnonzero(w)[:20]:
        for d in (0.05, -0.05):
            moved = w.copy()
            moved[k] += d
            assert loss(moved, b) > best
    assert loss(w, b + 0.1) > best and loss(w, b - 0.1) > best


def test_small_factorisation_machine_learns_a_product():
    """Neither word tells alone; their interaction does."""
    rng = np.random.default_rng(0)
    base = [f"w{i}" for i in range(30)]
    texts, y = [], []
    for _ in range(400):
        a, b = rng.integers(0, 2, 2)
        texts.append(" ".join([*rng.choice(base, 6), "aa" if a else "cc", "bb" if b else "dd"]))
        y.append(int(a == b))
    s = quality.Settings(epochs=60)
    model = quality.fit(texts, np.array([len(t) for t in texts], float), np.array(y, float), {0: y.count(0), 1: y.count(1)}, s)
    idx, offs, stats = quality.features(*tk.buffers(__import__("pyarrow").array(texts)), np.array([len(t) for t in texts], float), s)
    z = quality.margin(model, *quality.design(idx, offs, stats, model["edges"], s))
    assert ((z > 0) == np.array(y)).mean() > 0.9
