"""Language-model scores by context-tree weighting over bytes (operator 7).

The model predicts each byte of a lower-cased text, and then its end, from up
to ``depth`` bytes before it.  A byte is eight binary choices; each of the 255
binary nodes has a context tree of its own, and a node of that tree holds the
Krichevsky-Trofimov estimate of its zeros and ones.  Context-tree weighting
mixes the estimates of all depths: with ``Pw = 1/2 Pkt + 1/2 prod Pw(children)``
a node's own estimate weighs ``lambda = 1/2 Pkt / Pw`` against its child's, from
the empty context down to the longest.  Counts come from all training texts.

How it is spread:

1. Documents get a block each (about ``block_bytes`` of text that is read
   together).  A pass over the blocks gives the distinct (depth + 1)-byte strings of each block with their
   training counts, and the distinct words.
2. Counts are summed over blocks by string and by word.
3. Strings are sorted by context, most recent byte first, so subtrees are
   contiguous: levels deeper than ``split`` are worked out inside a task, one
   subtree after the other, levels above it as DataFrame aggregations.  The
   result is the code length of each string that occurs anywhere.
4. Each block gets the part of the model that its own strings and words use,
   and its documents are scored against it, streaming.

No table of strings or words is broadcast or collected; what a task holds is
bounded by the distinct strings of one block or one subtree.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm import textkit as tk
from touchline.session import scratch_path

U64 = np.uint64
EDGE = 255  # never a byte of UTF-8: what stands before a text, and its end
STRING, WORD, COUNT, DOC = 0, 1, 2, 3


@dataclass(frozen=True)
class Settings:
    depth: int = 5  # bytes of context
    split: int = 3  # contexts longer than this are worked out inside a task
    block_bytes: int = 40 << 20
    subtree_rows: int = 200_000  # strings worked on at a time, whole subtrees


# ------------------------------------------------------------------ strings of a chunk
def strings(data: np.ndarray, offs: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The (depth + 1)-byte string that ends at each byte and at each end of
    the documents (oldest byte highest), and each document's range of them."""
    n = len(offs) - 1
    size = np.diff(offs)
    x = np.full(depth + len(data) + depth * n, EDGE, np.uint8)
    x[np.arange(len(data)) + np.repeat(depth + depth * np.arange(n), size)] = data
    m = len(x) - depth
    k = x[:m].astype(U64)
    for j in range(1, depth + 1):
        k <<= U64(8)
        k |= x[j:m + j]
    # of the blanks after a text only the first, its end, is predicted
    new = np.concatenate([[0], np.cumsum(size + 1)])
    take = np.arange(new[-1]) + np.repeat((depth - 1) * np.arange(n), size + 1)
    return k[take], new


class Tally:
    """Distinct 64-bit keys with summed counts, in bounded steps."""

    def __init__(self) -> None:
        self.keys, self.counts, self.parts, self.waiting = np.zeros(0, U64), np.zeros(0, np.int64), [], 0

    def add(self, keys: np.ndarray, weight: bool) -> None:
        if len(keys) == 0:
            return
        u, c = np.unique(keys, return_counts=True)
        self.parts.append((u, c if weight else np.zeros(len(u), np.int64)))
        self.waiting += len(u)
        if self.waiting > max(1 << 20, len(self.keys)):
            self.merge()

    def merge(self) -> None:
        k = np.concatenate([self.keys, *[p[0] for p in self.parts]])
        c = np.concatenate([self.counts, *[p[1] for p in self.parts]])
        self.parts, self.waiting = [], 0
        if len(k) == 0:
            return
        order = np.argsort(k, kind="stable")
        k, c = k[order], c[order]
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        self.keys, self.counts = k[first], np.add.reduceat(c, first)


class Lookup:
    """Values by distinct 64-bit key: a few direct tables, each for what the
    last could not place."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.levels, self.values = [], values
        rng = np.random.default_rng(3)
        at = np.arange(len(keys), dtype=np.int32)
        while len(keys):
            bits = max(4, int(np.ceil(np.log2(len(keys)))))
            odd, shift = rng.integers(0, 2**63, dtype=U64) * U64(2) + U64(1), U64(64 - bits)
            slot = ((keys * odd) >> shift).view(np.int64)
            table, place = np.zeros(1 << bits, U64), np.full(1 << bits, -1, np.int32)
            table[slot], place[slot] = keys, at  # of several keys the last stays
            self.levels.append((odd, shift, table, place))
            rest = place[slot] != at
            keys, at = keys[rest], at[rest]

    def get(self, q: np.ndarray, missing: float) -> np.ndarray:
        out = np.full(len(q), missing)
        todo = np.arange(len(q))
        for odd, shift, table, place in self.levels:
            k = q[todo]
            slot = ((k * odd) >> shift).view(np.int64)
            found = place[slot]
            hit = (table[slot] == k) & (found >= 0)
            out[todo[hit]] = self.values[found[hit]]
            todo = todo[~hit]
            if len(todo) == 0:
                break
        return out


def _count(s: Settings):
    """Arrow function over rows ``(block, train, text)`` sorted by block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, grams, words, ends = None, Tally(), Tally(), 0

        def out() -> Iterator[pa.RecordBatch]:
            for kind, t in ((STRING, grams), (WORD, words)):
                t.merge()
                for lo in range(0, len(t.keys), 100_000):
                    k, c = t.keys[lo:lo + 100_000], t.counts[lo:lo + 100_000]
                    yield rows(kind, k.view(np.int64), c)
            yield rows(COUNT, np.zeros(1, np.int64), np.array([ends]))

        def rows(kind: int, k: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(k), at, np.int64)), pa.array(np.full(len(k), kind, np.int32)), pa.array(k),
                 pa.array(c.astype(np.int64))], names=["block", "kind", "key", "n"])

        for batch in batches:
            block = batch.column(0).to_numpy(zero_copy_only=False)
            train = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            cuts = np.flatnonzero((block[1:] != block[:-1]) | (train[1:] != train[:-1])) + 1 if len(block) else []
            for lo, hi in zip([0, *cuts], [*cuts, len(block)], strict=True):
                if lo == hi:
                    continue
                if at is not None and block[lo] != at:
                    yield from out()
                    grams, words, ends = Tally(), Tally(), 0
                at = block[lo]
                ends += (hi - lo) if train[lo] else 0
                for _, _, data, offs in tk.documents(batch.column(2).slice(lo, hi - lo)):
                    grams.add(strings(data, offs, s.depth)[0], bool(train[lo]))
                    st, en, _ = tk.find_words(data, offs)
                    words.add(tk.hash_words(data, st, en), bool(train[lo]))
        if at is not None:
            yield from out()
    return run


# ------------------------------------------------------------------ the context tree
def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma for x >= 0.5 (Stirling's series after a shift by 7)."""
    p = x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5) * (x + 6)
    z = x + 7.0
    z2 = z * z
    return (z - 0.5) * np.log(z) - z + 0.9189385332046727 + \
        (1 / 12.0 - (1 / 360.0 - (1 / 1260.0 - 1 / (1680.0 * z2)) / z2) / z2) / z - np.log(p)


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """ln of the KT probability of ``a`` zeros and ``b`` ones."""
    return log_gamma(a + 0.5) + log_gamma(b + 0.5) - log_gamma(a + b + 1.0) - math.log(math.pi)


def log_mix(own: np.ndarray, below: np.ndarray) -> np.ndarray:
    return np.logaddexp(own, below) - math.log(2.0)


class Level:
    """The binary nodes of one context length: sorted ids, counts, ln Pw."""

    def __init__(self, ids, zeros, ones, weighted):
        self.ids, self.zeros, self.ones, self.weighted = ids, zeros, ones, weighted

    def share(self, leaf: bool) -> tuple[np.ndarray, np.ndarray]:
        """Weight of the own estimate and the chance of a one by it."""
        kt = (self.ones + 0.5) / (self.zeros + self.ones + 1.0)
        if leaf:
            return np.ones(len(kt)), kt
        return np.exp(np.minimum(log_kt(self.zeros, self.ones) - math.log(2.0) - self.weighted, 0.0)), kt


def _nodes(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids ``context << 8 | node`` of the eight choices of each string, and the bits taken."""
    sym = (keys & U64(255)).astype(np.int64)
    j = np.arange(8)
    node = (1 << j)[None, :] | (sym[:, None] >> (8 - j)[None, :])
    bit = (sym[:, None] >> (7 - j)[None, :]) & 1
    ctx = (keys >> U64(8)).astype(np.int64)
    return (ctx[:, None] << 8) | node, bit


def climb(keys: np.ndarray, n: np.ndarray, depth: int, to: int) -> tuple[list[Level], np.ndarray]:
    """Levels ``depth`` to ``to`` (last) of the trees of the strings, and the
    place of each string's eight nodes in the deepest level."""
    ids, bit = _nodes(keys)
    flat = ids.ravel()
    u, inv = np.unique(flat, return_inverse=True)
    w = np.repeat(n.astype(float), 8)
    ones = np.bincount(inv, weights=w * bit.ravel(), minlength=len(u))
    zeros = np.bincount(inv, weights=w, minlength=len(u)) - ones
    levels = [Level(u, zeros, ones, log_kt(zeros, ones))]
    for d in range(depth - 1, to - 1, -1):
        low = levels[-1]
        up = low.ids & ((1 << (8 * d + 8)) - 1)
        u, up = np.unique(up, return_inverse=True)
        zeros = np.bincount(up, weights=low.zeros, minlength=len(u))
        ones = np.bincount(up, weights=low.ones, minlength=len(u))
        below = np.bincount(up, weights=low.weighted, minlength=len(u))
        low.up = up
        levels.append(Level(u, zeros, ones, log_mix(log_kt(zeros, ones), below)))
    return levels, inv


def code_lengths(keys: np.ndarray, n: np.ndarray, top: tuple[np.ndarray, np.ndarray, np.ndarray], depth: int,
                 split: int) -> np.ndarray:
    """log2 probability of the last byte of each string given its context.
    ``top``: ids of the level ``split`` with (a, b), where the chance of a one
    is ``a + b * (chance by the deeper levels)``."""
    levels, inv = climb(keys, n, depth, split + 1)
    ids, a0, b0 = top
    last = levels[-1]
    at = np.searchsorted(ids, last.ids & ((1 << (8 * split + 8)) - 1))
    a, b = a0[at], b0[at]
    for k in range(len(levels) - 1, -1, -1):
        lam, kt = levels[k].share(leaf=k == 0)
        a, b = a + b * lam * kt, b * (1.0 - lam)
        if k:
            a, b = a[levels[k - 1].up], b[levels[k - 1].up]
    bit = _nodes(keys)[1].ravel()
    p = a[inv]
    return np.log2(np.clip(np.where(bit == 1, p, 1.0 - p), 1e-300, 1.0)).reshape(-1, 8).sum(axis=1)


def _by_subtree(s: Settings, work, names: list[str]):
    """Arrow function over rows ``(ctx, kind, key, n, a, b)`` sorted by ``ctx``
    (the context of length ``split``) and kind: ``work`` gets whole subtrees."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def out() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            cols = [t[c].to_numpy() for c in ("kind", "key", "n", "a", "b")]
            got = work(*cols)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in got], names=names)

        for batch in batches:
            if batch.num_rows == 0:
                continue
            ctx = batch.column(0).to_numpy(zero_copy_only=False)
            last = held[-1].column(0)[held[-1].num_rows - 1].as_py() if held else None
            cuts = np.flatnonzero(np.concatenate([[last is not None and ctx[0] != last], ctx[1:] != ctx[:-1]]))
            lo = 0
            for c in cuts.tolist():
                if rows + c - lo >= s.subtree_rows:
                    if c > lo:
                        held.append(batch.slice(lo, c - lo))
                    yield from out()
                    held, rows, lo = [], 0, c
            held.append(batch.slice(lo))
            rows += batch.num_rows - lo
        if held:
            yield from out()
    return run


def _ln_gamma(x: Column) -> Column:
    p = x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5) * (x + 6)
    z = x + 7.0
    z2 = z * z
    r = (F.lit(1 / 12.0) - (F.lit(1 / 360.0) - (F.lit(1 / 1260.0) - F.lit(1.0) / (F.lit(1680.0) * z2)) / z2) / z2) / z
    return (z - 0.5) * F.log(z) - z + F.lit(0.9189385332046727) + r - F.log(p)


def _ln_kt() -> Column:
    a, b = F.col("n0"), F.col("n1")
    return _ln_gamma(a + 0.5) + _ln_gamma(b + 0.5) - _ln_gamma(a + b + 1.0) - F.lit(math.log(math.pi))


def tree(grams: DataFrame, s: Settings) -> DataFrame:
    """``key, bits``: log2 probability of each string of ``(key, n)``."""
    spark = grams.sparkSession
    q, mask = s.split, (1 << (8 * s.split)) - 1
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), grams.count() // (2 * s.subtree_rows) + 1)
    ctx = F.shiftright("key", 8).bitwiseAND(F.lit(mask)).alias("ctx")
    none = F.lit(0.0)
    lean = grams.select(ctx, F.lit(1).alias("kind"), "key", "n", none.alias("a"), none.alias("b"))

    def up(kind, key, n, a, b):
        top = climb(key.view(U64), n, s.depth, q)[0][-1]
        return top.ids, top.zeros, top.ones, top.weighted

    schema = "id long, n0 double, n1 double, w double"
    level = (lean.repartition(parts, "ctx").sortWithinPartitions("ctx", "kind", "key")
             .mapInArrow(_by_subtree(s, up, ["id", "n0", "n1", "w"]), schema))
    levels = []
    for d in range(q, -1, -1):
        if d < q:
            m = (1 << (8 * d + 8)) - 1
            level = (levels[-1].groupBy(F.col("id").bitwiseAND(F.lit(m)).alias("id"))
                     .agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("w").alias("below")))
            own, below = _ln_kt(), F.col("below")
            top = F.greatest(own, below)
            level = level.select("id", "n0", "n1", (top + F.log1p(F.exp(F.least(own, below) - top)) -
                                                    math.log(2.0)).alias("w"))
        path = scratch_path(spark, f"ctw-level{d}")
        level.write.option("compression", "zstd").parquet(path)
        levels.append(spark.read.parquet(path))
    top = None
    for d in range(q + 1):  # from the empty context down
        lam = F.exp(F.least(_ln_kt() - math.log(2.0) - F.col("w"), F.lit(0.0)))
        one = (F.col("n1") + 0.5) / (F.col("n0") + F.col("n1") + 1.0)
        here = levels[q - d].select("id", lam.alias("lam"), one.alias("one"))
        if d == 0:
            top = here.select("id", (F.col("lam") * F.col("one")).alias("a"), (1 - F.col("lam")).alias("b"))
        else:
            m = (1 << (8 * d)) - 1
            up_ = top.select(F.col("id").alias("up"), F.col("a").alias("a0"), F.col("b").alias("b0"))
            top = here.join(up_, F.col("id").bitwiseAND(F.lit(m)) == F.col("up")).select(
                "id", (F.col("a0") + F.col("b0") * F.col("lam") * F.col("one")).alias("a"),
                (F.col("b0") * (1 - F.col("lam"))).alias("b"))
    above = top.select(F.shiftright("id", 8).alias("ctx"), F.lit(0).alias("kind"), F.col("id").alias("key"),
                       F.lit(0).cast("long").alias("n"), "a", "b")

    def down(kind, key, n, a, b):
        is_top = kind == 0
        ids = key[is_top]
        order = np.argsort(ids, kind="stable")
        keys = key[~is_top].view(U64)
        bits = code_lengths(keys, n[~is_top], (ids[order], a[is_top][order], b[is_top][order]), s.depth, q)
        return keys.view(np.int64), bits

    both = lean.unionByName(above).repartition(parts, "ctx").sortWithinPartitions("ctx", "kind", "key")
    return both.mapInArrow(_by_subtree(s, down, ["key", "bits"]), "key long, bits double")


# ------------------------------------------------------------------ scoring
def _score(s: Settings, total: int, kinds: int, ends: int):
    """Arrow function over rows sorted by block and kind: the block's part of
    the model comes first, then its documents."""
    end_log = math.log10(ends + 0.5)
    norm = math.log10(total + 0.5 * (kinds + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, model = None, {STRING: [], WORD: []}, None

        def ready() -> dict[int, Lookup]:
            got = {}
            for kind, rows in parts.items():
                k = np.concatenate([r[0] for r in rows]) if rows else np.zeros(0, np.int64)
                v = np.concatenate([r[1] for r in rows]) if rows else np.zeros(0)
                got[kind] = Lookup(k.view(U64), v)
                rows.clear()
            return got

        for batch in batches:
            block = batch.column(0).to_numpy(zero_copy_only=False)
            kind = batch.column(1).to_numpy(zero_copy_only=False)
            cuts = (np.flatnonzero((block[1:] != block[:-1]) | (kind[1:] != kind[:-1])) + 1).tolist() if len(block) else []
            for lo, hi in zip([0, *cuts], [*cuts, len(block)], strict=True):
                if lo == hi:
                    continue
                if block[lo] != at:
                    at, model = block[lo], None
                    parts[STRING].clear()
                    parts[WORD].clear()
                rows = batch.slice(lo, hi - lo)
                if kind[lo] != DOC:
                    parts[int(kind[lo])].append((rows.column(2).to_numpy(zero_copy_only=False).copy(),
                                                 rows.column(3).to_numpy(zero_copy_only=False).copy()))
                    continue
                model = model or ready()
                cols = [[], [], [], [], []]
                for _, _, data, offs in tk.documents(rows.column(6), 1 << 20):
                    k, o = strings(data, offs, s.depth)
                    bits = model[STRING].get(k, np.nan)
                    if np.isnan(bits).any():
                        raise RuntimeError("a string of the text is not in its block's model")
                    st, en, wo = tk.find_words(data, offs)
                    c = model[WORD].get(tk.hash_words(data, st, en), 0.0)
                    words = np.diff(wo)
                    cols[0].append(words + 1)
                    cols[1].append(np.round(sums(c > 0, wo)).astype(np.int64) + (ends > 0))
                    cols[2].append(sums(np.log10(c + 0.5), wo) + end_log - (words + 1) * norm)
                    cols[3].append(sums(bits, o))
                    cols[4].append(np.diff(o))
                n, known, base, bits, symbols = (np.concatenate(c) for c in cols)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(4), rows.column(5), pa.array(n.astype(np.int64)), pa.array(known), pa.array(base),
                     pa.array(bits), pa.array(symbols)],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "log2", "n_symbols"])
    return run


def sums(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sums of consecutive segments, each added up on its own; empty ones are 0."""
    out = np.zeros(len(offs) - 1)
    some = np.flatnonzero(np.diff(offs) > 0)
    if len(some):
        out[some] = np.add.reduceat(values.astype(float), offs[:-1][some])
    return out


def scores(docs: DataFrame, held_out: Column, s: Settings = Settings()) -> DataFrame:
    """One row per document: ``doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score, score, bits_per_byte``.

    ``score`` is the model's log10 probability of the lower-cased text and its
    end; ``bits_per_byte`` the code length over all bytes and the end.  The
    base is a word model with half a count added; words are told apart by 64-bit
    hashes.  The model learns from rows that are not held out; without any the
    base knows no word and the model is uniform.  A null text is empty (its
    end alone is predicted); repeated rows each count and score alike; a null
    doc_id is scored like any other.  Extra columns are ignored; an empty
    table gives an empty result."""
    spark = docs.sparkSession
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    total = docs.agg(F.sum(size)).first()[0] or 0
    # the text by block, written once: later steps must see the same blocks.  A
    # block is (a part of) what one task reads, so the text does not move yet
    blocks = max(1, math.ceil(total / s.block_bytes))
    near = docs.coalesce(blocks)
    parts = max(1, near.rdd.getNumPartitions())
    cut = max(1, round(total / s.block_bytes / parts))
    block = F.spark_partition_id().cast("long") * cut + F.pmod(F.xxhash64("doc_id", "text"), F.lit(cut))
    path = scratch_path(spark, "ctw-texts")
    src = near.select(block.alias("block"), (~held_out).alias("train"), F.col("doc_id").cast("long").alias("doc_id"),
                      held_out.alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    src.sortWithinPartitions("block", "train").write.option("compression", "zstd").parquet(path)
    src = spark.read.parquet(path)
    path = scratch_path(spark, "ctw-counts")
    (src.select("block", "train", "text").mapInArrow(_count(s), "block long, kind int, key long, n long")
     .write.option("compression", "zstd").parquet(path))
    counts = spark.read.parquet(path)
    by_word = Window.partitionBy("key")
    words = counts.where(F.col("kind") == WORD).select(
        "block", "key", F.sum("n").over(by_word).cast("double").alias("value"),
        F.count(F.lit(1)).over(by_word).alias("times"), "n")
    path = scratch_path(spark, "ctw-words")
    words.write.option("compression", "zstd").parquet(path)
    words = spark.read.parquet(path)
    some = words.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("value") > 0, 1.0 / F.col("times"))).alias("v")).first()
    ends = counts.where(F.col("kind") == COUNT).agg(F.sum("n")).first()[0] or 0
    train_tokens = int(some["n"] or 0) + ends
    kinds = int(round(some["v"] or 0.0)) + (1 if ends else 0)
    own = counts.where(F.col("kind") == STRING).select("block", "key", "n")
    path = scratch_path(spark, "ctw-strings")
    own.groupBy("key").agg(F.sum("n").alias("n")).write.option("compression", "zstd").parquet(path)
    model = tree(spark.read.parquet(path), s)
    empty = [F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("boolean").alias("held_out"),
             F.lit(None).cast("string").alias("text")]
    part = own.join(model, "key").select("block", F.lit(STRING).alias("kind"), "key", F.col("bits").alias("value"), *empty)
    part = part.unionByName(words.where("value > 0").select("block", F.lit(WORD).alias("kind"), "key", "value", *empty))
    rows = part.unionByName(src.select("block", F.lit(DOC).alias("kind"), F.lit(0).cast("long").alias("key"),
                                       F.lit(0.0).alias("value"), "doc_id", "held_out", "text"))
    # a task for each block: block numbers are partition numbers
    out = rows.repartitionById(parts * cut, F.col("block").cast("int")).sortWithinPartitions("block", "kind").mapInArrow(
        _score(s, train_tokens, kinds, ends),
        "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, log2 double, n_symbols long")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(train_tokens).cast("long").alias("train_tokens"),
                      "base_score", (F.col("log2") * F.lit(math.log10(2.0))).alias("score"),
                      (-F.col("log2") / F.col("n_symbols")).alias("bits_per_byte"))
