"""Quality scores by a factorisation machine over hashed words, structure
statistics and metadata (operator 6)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm import textkit as tk
from touchline.llm.train import labelled, sample, sigmoid, sums


@dataclass(frozen=True)
class Settings:
    bits: int = 15  # of the word hash
    rank: int = 8
    bins: int = 12  # of each statistic
    per_class: int = 3000  # labelled rows fitted on, of each class
    max_bytes: int = 16 << 20  # and their text
    ridge: float = 1e-4
    epochs: int = 12
    batch: int = 128


#: Statistics of a text; ``stated_length`` is the table's own ``n_chars`` against the text.
STATS = ("words", "word_length", "upper", "digit", "punct", "odd_end", "wide", "line_length", "lines",
         "distinct_words", "top_word", "repeated_lines", "stated_length")
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_ALPHA = _UPPER.copy()
_ALPHA[97:123] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[33:127] = True
_PUNCT &= ~(_ALPHA | _DIGIT)
_STOP = np.zeros(256, bool)
_STOP[[33, 41, 44, 46, 58, 59, 63]] = True  # ! ) , . : ; ?


def features(raw: np.ndarray, offs: np.ndarray, stated: np.ndarray, s: Settings):
    """Distinct hashed words of each document (indices, offsets) and its statistics."""
    data = tk.LOWER[raw]
    st, en, wo = tk.find_words(data, offs)
    h = tk.hash_words(data, st, en)
    n = len(offs) - 1
    nb = np.maximum(np.diff(offs), 1).astype(float)
    nw = np.maximum(np.diff(wo), 1).astype(float)
    share = lambda lut: sums(lut[raw].astype(np.float32), offs) / nb
    odd = _PUNCT[data[en - 1]] & ~_STOP[data[en - 1]] if len(en) else np.zeros(0, bool)
    newline = raw == 10
    stats = np.zeros((n, len(STATS)))
    stats[:, 0] = np.log1p(np.diff(wo))
    stats[:, 1] = sums((en - st).astype(float), wo) / nw
    stats[:, 2], stats[:, 3], stats[:, 4] = share(_UPPER), share(_DIGIT), share(_PUNCT)
    stats[:, 5] = sums(odd.astype(float), wo) / nw
    stats[:, 6] = share(np.arange(256) >= 128)
    lines = sums(newline.astype(np.float32), offs) + 1
    stats[:, 7], stats[:, 8] = nb / lines, np.log(lines)
    chars = sums(((raw & 0xC0) != 0x80).astype(np.float32), offs)
    stats[:, 12] = np.clip(np.log((stated + 1.0) / (chars + 1.0)), -5, 5)
    idx, sizes = [], []
    b = np.uint64(64 - s.bits)
    for i in range(n):
        w = h[wo[i]:wo[i + 1]]
        u, c = np.unique(w, return_counts=True)
        stats[i, 9] = len(u) / nw[i]
        stats[i, 10] = c.max() / nw[i] if len(c) else 0.0
        rows = raw[offs[i]:offs[i + 1]].tobytes().split(b"\n")
        stats[i, 11] = 1 - len(set(rows)) / len(rows)
        g = np.unique((u >> b).astype(np.int32))
        idx.append(g)
        sizes.append(len(g))
    return (np.concatenate(idx) if idx else np.zeros(0, np.int32)), \
        np.concatenate([[0], np.cumsum(sizes)]).astype(int), stats


def design(idx: np.ndarray, offs: np.ndarray, stats: np.ndarray, edges: np.ndarray, s: Settings):
    """One sparse row per document: words share a norm of 1, each statistic
    sets the indicator of its bin.  Returns columns, values and offsets."""
    n = len(offs) - 1
    k = stats.shape[1]
    nw = np.diff(offs)
    cols = np.empty(len(idx) + n * k, np.int64)
    vals = np.empty(len(cols))
    new = offs + np.arange(n + 1) * k
    doc = np.repeat(np.arange(n), nw)
    at = np.arange(len(idx)) + doc * k
    cols[at] = idx
    vals[at] = 1.0 / np.sqrt(np.maximum(nw, 1))[doc]
    for j in range(k):
        place = new[:-1] + nw + j
        cols[place] = (1 << s.bits) + j * s.bins + np.searchsorted(edges[j], stats[:, j], side="right")
        vals[place] = 1.0
    return cols, vals, new


def margin(model: dict, cols: np.ndarray, vals: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Linear part plus all pairwise interactions in linear time: half of
    (sum of v x)^2 - sum of (v x)^2 over the rank."""
    vx = model["v"][cols] * vals[:, None]
    a, q = sums(vx, offs), sums(vx * vx, offs)
    return model["b"] + sums(model["w"][cols] * vals, offs) + 0.5 * (a * a - q).sum(axis=1)


def fit(texts: list, stated: np.ndarray, y: np.ndarray, totals: dict[int, int], s: Settings) -> dict:
    """Adam on mini-batches of the logistic loss; without both classes the
    model is the prior alone."""
    size = (1 << s.bits) + len(STATS) * s.bins
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    rng = np.random.default_rng(20240229)
    model = {"b": float(np.log((n1 + 0.5) / (n0 + 0.5))), "w": np.zeros(size), "v": np.zeros((size, s.rank)),
             "edges": np.zeros((len(STATS), s.bins - 1))}
    if len(y) == 0 or y.min() == y.max():
        return model
    idx, offs, stats, at = [], [np.zeros(1, int)], [], 0
    raw, o = tk.buffers(pa.array([t or "" for t in texts], pa.string()))
    for lo, hi in tk.chunks(o):
        i, p, z = features(raw[o[lo]:o[hi]], o[lo:hi + 1] - o[lo], stated[lo:hi], s)
        idx.append(i)
        offs.append(p[1:] + at)
        stats.append(z)
        at += p[-1]
    idx, offs, stats = np.concatenate(idx), np.concatenate(offs), np.concatenate(stats)
    # bins hold equal parts of each class
    weight = np.where(y == 1, n1 / y.sum(), n0 / (1 - y).sum())
    weight = weight / weight.mean()
    model["edges"] = np.stack([np.quantile(stats[:, j], np.linspace(0, 1, s.bins + 1)[1:-1]) for j in range(len(STATS))])
    cols, vals, offs = design(idx, offs, stats, model["edges"], s)
    model["v"] = rng.normal(0, 0.05, (size, s.rank))
    w, v, b = model["w"], model["v"], model["b"]
    mw, hw, mv, hv = np.zeros_like(w), np.zeros_like(w), np.zeros_like(v), np.zeros_like(v)
    for epoch in range(s.epochs):
        rate = 0.03 * (1 - epoch / s.epochs)
        order = rng.permutation(len(y))
        for lo in range(0, len(y), s.batch):
            rows = order[lo:lo + s.batch]
            pick = np.concatenate([np.arange(offs[r], offs[r + 1]) for r in rows])
            c, x = cols[pick], vals[pick]
            lens = offs[rows + 1] - offs[rows]
            o = np.concatenate([[0], np.cumsum(lens)])
            vx = v[c] * x[:, None]
            a = sums(vx, o)
            z = b + sums(w[c] * x, o) + 0.5 * (a * a - sums(vx * vx, o)).sum(axis=1)
            e = (sigmoid(z) - y[rows]) * weight[rows] / len(rows)
            d = np.repeat(np.arange(len(rows)), lens)
            u, inv = np.unique(c, return_inverse=True)
            gw = np.bincount(inv, weights=e[d] * x, minlength=len(u)) + s.ridge * w[u]
            gx = e[d][:, None] * x[:, None] * (a[d] - vx)
            gv = np.stack([np.bincount(inv, weights=gx[:, f], minlength=len(u)) for f in range(s.rank)], 1) \
                + s.ridge * v[u]
            mw[u], hw[u] = 0.9 * mw[u] + 0.1 * gw, 0.99 * hw[u] + 0.01 * gw * gw
            mv[u], hv[u] = 0.9 * mv[u] + 0.1 * gv, 0.99 * hv[u] + 0.01 * gv * gv
            w[u] -= rate * mw[u] / (np.sqrt(hw[u]) + 1e-6)
            v[u] -= rate * mv[u] / (np.sqrt(hv[u]) + 1e-6)
            b -= rate * e.sum()
    model["b"] = float(b)
    return model


def score(docs: DataFrame, model: dict, s: Settings) -> DataFrame:
    """``doc_id, score`` of each whole text."""
    lean = {k: np.asarray(x, np.float32) if k in ("w", "v") else x for k, x in model.items()}
    held = docs.sparkSession.sparkContext.broadcast(lean)  # 2^bits rows of rank weights, a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            raw, offs = tk.buffers(batch.column(1))
            stated = batch.column(2).to_numpy(zero_copy_only=False)
            out = []
            for lo, hi in tk.chunks(offs, 1 << 20):
                i, o, z = features(raw[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo], stated[lo:hi], s)
                out.append(sigmoid(margin(m, *design(i, o, z, m["edges"], s))))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())],
                names=["doc_id", "score"])

    return _lean(docs).mapInArrow(run, "doc_id long, score double")


def _lean(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       _stated(docs).alias("n_chars"))


def _stated(docs: DataFrame) -> Column:
    given = F.col("n_chars") if "n_chars" in docs.columns else F.lit(None)
    return F.coalesce(given.cast("double"), F.length("text").cast("double"), F.lit(0.0))


def trained(docs: DataFrame, labels: DataFrame, train: Column, s: Settings = Settings()) -> dict:
    """A model fitted on a bounded sample (``per_class``, ``max_bytes``) of labelled rows."""
    lean = docs.withColumn("_stated", _stated(docs))
    known = labelled(lean, labels, "quality", train)
    rows, totals = sample(lean, known, "quality", train, s.per_class, s.max_bytes, ["text", "_stated"])
    return fit(rows["text"].tolist(), rows["_stated"].to_numpy(float), rows["y"].to_numpy(float), totals, s)


def quality(docs: DataFrame, labels: DataFrame, held_out: Column, s: Settings = Settings()) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``.

    Learns from labelled rows that are not held out and scores every whole
    text.  A null text scores as an empty one, a null ``n_chars`` as the
    text's own length; repeated rows score alike; a null doc_id is scored but
    never fitted on.  Without labels of both classes every score is the
    prior.  Extra columns are ignored; an empty table gives an empty result."""
    model = trained(docs, labels, ~held_out, s)
    out = score(docs, model, s)
    return out.select("doc_id", held_out.alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, train: Column, s: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject; rows and columns as they were.

    All columns travel with their text through one pass, so nothing is joined back."""
    model = trained(docs, labels, train, s)
    lean = {k: np.asarray(x, np.float32) if k in ("w", "v") else x for k, x in model.items()}
    held = docs.sparkSession.sparkContext.broadcast(lean)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            raw, offs = tk.buffers(batch.column(len(names)))
            stated = batch.column(len(names) + 1).to_numpy(zero_copy_only=False)
            ok = []
            for lo, hi in tk.chunks(offs, 1 << 20):
                i, o, z = features(raw[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo], stated[lo:hi], s)
                ok.append(margin(m, *design(i, o, z, m["edges"], s)) >= 0)
            mask = pa.array(np.concatenate(ok) if ok else np.zeros(0, bool))
            yield batch.select(list(range(len(names)))).filter(mask)

    plain, c = tk.numbered(docs)
    given = F.col(c["n_chars"]) if "n_chars" in c else F.lit(None)
    text = F.col(c["text"]).cast("string")
    stated = F.coalesce(given.cast("double"), F.length(text).cast("double"), F.lit(0.0))
    work = plain.select("*", text.alias("_text"), stated.alias("_stated"))
    return work.mapInArrow(run, docs.schema)
