"""Toxicity scores: character n-grams weighted by naive Bayes log-count ratios
and a logistic model on top (operator 3).

The ratios come from all labelled training texts: tasks count, for each hashed
n-gram and class, the texts that hold it, and Spark adds the counts up in two
steps.  The logistic weights on the scaled features are fitted on a bounded
sample of these texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm import textkit as tk
from touchline.llm.train import keyed, labelled, sample, sigmoid, sums


@dataclass(frozen=True)
class Settings:
    orders: tuple[int, ...] = (3, 4, 5)
    bits: int = 18
    per_class: int = 2500  # labelled rows fitted on, of each class
    max_bytes: int = 8 << 20  # and their text
    ridge: float = 1e-3
    steps: int = 150
    least_texts: int = 3  # n-grams in fewer labelled texts say nothing
    least_ratio: float = 0.4  # nor do those whose log-count ratio is closer to 0


def grams(data: np.ndarray, offs: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed n-grams of each document (lower-cased bytes, runs of
    white space as one blank): indices and offsets."""
    sp = tk.SPACE[data]
    drop = np.zeros(len(data), bool)
    if len(data):
        drop[1:] = sp[1:] & sp[:-1]
        cut = offs[:-1][offs[:-1] < len(data)]
        drop[cut] = False
    x = np.where(sp, np.uint8(32), data)[~drop].astype(np.uint64)
    o = offs - np.concatenate([[0], np.cumsum(drop)])[offs]
    shift = np.uint64(64 - s.bits)
    per = []
    for n in s.orders:
        if len(x) < n:
            per.append(np.zeros(0, np.uint64))
            continue
        h = np.full(len(x) - n + 1, n, np.uint64)
        for j in range(n):
            h = h * np.uint64(0x100000001B3) + x[j:len(x) - n + 1 + j]
        per.append(((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> shift)
    out, sizes = [], []
    for lo, hi in zip(o[:-1].tolist(), o[1:].tolist(), strict=True):
        # blanks at both ends make the first and last letters count like any word's
        parts = [h[lo:max(lo, hi - n + 1)] for n, h in zip(s.orders, per, strict=True)]
        g = np.concatenate(parts).astype(np.int32) if parts else np.zeros(0, np.int32)
        g.sort()
        if len(g):
            g = g[np.concatenate([[True], g[1:] != g[:-1]])]
        out.append(g)
        sizes.append(len(g))
    return (np.concatenate(out) if out else np.zeros(0, np.int32)), np.concatenate([[0], np.cumsum(sizes)]).astype(int)


BLOCK = 4096  # n-grams of a row of counts


def counts(docs: DataFrame, known: DataFrame, train: Column, s: Settings) -> np.ndarray:
    """Labelled training texts that hold each hashed n-gram, by class (2 x
    2^bits).  ``known`` is what ``labelled`` gives; rows that repeat an id share
    a weight of 1."""
    size = 1 << s.bits
    blocks = [(lo, min(size, lo + BLOCK)) for lo in range(0, size, BLOCK)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, at = np.zeros((2, size)), 0
        for b in batches:
            at = max(at, hash(b.column(0)[0].as_py())) if b.num_rows else at
            y, weight = b.column(2).to_numpy(), 1.0 / b.column(3).to_numpy()
            for lo, hi, data, o in tk.documents(b.column(1), 1 << 20):
                i, p = grams(data, o, s)
                n = np.diff(p)
                total += np.bincount(np.repeat(y[lo:hi].astype(np.int64), n) * size + i, weights=np.repeat(weight[lo:hi], n),
                                     minlength=2 * size).reshape(2, size)
        if total.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(blocks), dtype=np.int32)), pa.array(np.full(len(blocks), at % 256, np.int32)),
                 tk.binary_array([total[:, a:z].tobytes() for a, z in blocks])], names=["block", "turn", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}  # a few blocks: rows come sorted, but their number is fixed anyway
        for b in batches:
            for block, n in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                x = np.frombuffer(n)
                sums[block] = sums[block] + x if block in sums else x
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums), pa.int32()), pa.array([0] * len(sums), pa.int32()),
                 tk.binary_array([x.tobytes() for x in sums.values()])], names=["block", "turn", "n"])

    kind = "block int, turn int, n binary"
    texts = keyed(docs.where(train), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).drop("bytes").join(
        known.select("id", "digest", "y", "copies"), ["id", "digest"])
    parts = texts.select("id", "text", "y", "copies").mapInArrow(count, kind)
    summed = parts.repartition("block", "turn").mapInArrow(add, kind).repartition("block").mapInArrow(add, kind)
    out = np.zeros((2, size))
    for r in summed.select("block", "n").collect():  # 2^bits / BLOCK rows
        lo, hi = blocks[r["block"]]
        out[:, lo:hi] += np.frombuffer(bytes(r["n"])).reshape(2, -1)
    return np.round(out, 6)  # the same in whatever order shares were added


def ratios(n: np.ndarray, totals: dict[int, int], s: Settings) -> np.ndarray:
    """Log-count ratios of the n-grams; 0 for those that say next to nothing."""
    p, q = (n[1] + 1) / (totals.get(1, 0) + 2), (n[0] + 1) / (totals.get(0, 0) + 2)
    r = np.log(p / q)
    r[(n.sum(axis=0) < s.least_texts) | (np.abs(r) < s.least_ratio)] = 0.0
    return r


def fit(texts: list, y: np.ndarray, totals: dict[int, int], r: np.ndarray, s: Settings) -> tuple[np.ndarray, float]:
    """Weights of the hashed n-grams and the intercept, for features scaled by
    the ratios ``r``.  Without both classes all weights are 0 and the intercept
    is the prior."""
    w = np.zeros(1 << s.bits)
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    prior = float(np.log((n1 + 0.5) / (n0 + 0.5)))
    if len(y) == 0 or y.min() == y.max():
        return w, prior
    text = pa.array([t or "" for t in texts], pa.string())
    idx, doc = [], []
    for lo, _, data, o in tk.documents(text, 1 << 20):
        i, p = grams(data, o, s)
        keep = r[i] != 0
        idx.append(i[keep])
        doc.append(np.repeat(np.arange(len(p) - 1, dtype=np.int32) + lo, np.diff(p))[keep])
    idx, doc = np.concatenate(idx), np.concatenate(doc)
    offs = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(y)))])
    used = np.flatnonzero(np.bincount(idx, minlength=1 << s.bits))
    place = np.zeros(1 << s.bits, np.int32)
    place[used] = np.arange(len(used))
    cols = place[idx]
    x = r[idx].astype(np.float32)
    del idx
    # classes weigh as in all training rows
    weight = np.where(y == 1, n1 / max(1, y.sum()), n0 / max(1, (1 - y).sum()))
    weight = weight / weight.sum()
    v, b = np.zeros(len(used)), prior
    m, h = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for t in range(1, s.steps + 1):
        e = (sigmoid(sums(v[cols] * x, offs) + b) - y) * weight
        g = np.concatenate([np.bincount(cols, weights=x * e[doc], minlength=len(used)) + s.ridge * v, [e.sum()]])
        m, h = 0.9 * m + 0.1 * g, 0.99 * h + 0.01 * g * g
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(h / (1 - 0.99**t)) + 1e-8) * min(1.0, 2.0 * (1 - t / (s.steps + 1)))
        v, b = v - step[:-1], b - step[-1]
    w[used] = v * r[used]
    return w, float(b)


def score(docs: DataFrame, w: np.ndarray, b: float, s: Settings) -> DataFrame:
    """``doc_id, score`` of each whole text."""
    model = docs.sparkSession.sparkContext.broadcast((w.astype(np.float32), b))  # 2^bits weights, a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = model.value
        for batch in batches:
            out = []
            for _, _, data, offs in tk.documents(batch.column(1), 1 << 20):
                i, o = grams(data, offs, s)
                out.append(sigmoid(sums(weights[i], o) + bias))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())],
                names=["doc_id", "score"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, held_out: Column, s: Settings = Settings()) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``.

    The ratios are counted over all labelled rows that are not held out, the
    weights fitted on a bounded sample of these (``per_class``, ``max_bytes``;
    rows that repeat an id are one), and every whole text is scored; a null text scores
    as an empty one (the prior), repeated rows score alike, a null doc_id is
    scored but never fitted on.  Without labels of both classes every score is
    the prior (0.5 if there is no label at all).  Extra columns are ignored;
    an empty table gives an empty result."""
    known = labelled(docs, labels, "toxic", ~held_out)
    rows, totals = sample(docs, known, "toxic", ~held_out, s.per_class, s.max_bytes, ["text"])
    r = ratios(counts(docs, known, ~held_out, s), totals, s)
    w, b = fit(rows["text"].tolist(), rows["y"].to_numpy(float), totals, r, s)
    out = score(docs, w, b, s)
    return out.select("doc_id", held_out.alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"))
