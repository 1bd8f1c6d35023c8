"""Benchmark decontamination by CGK embeddings and bit-sampling LSH (operator 9).

Texts and benchmark items are sequences of words (lower case, ASCII
punctuation dropped).  A text holds an item when a stretch of it is within
``rate`` of the item's length in word edits.

Windows as long as an item start at every word of a text.  The CGK walk writes
a window out over three times its length, at each step standing still or
moving on by one word as a random function of step and word decides; two
sequences at a small edit distance give outputs at a small Hamming distance.
Each of ``repeats`` walks (own random functions) samples ``bits`` of its
output places and looks the sample up among those of the items of that length;
what is found is verified by an exact edit distance against the text.

Two necessary conditions, so losing nothing, say which windows need no
embedding: an item that is met within ``k`` edits keeps one of any ``k + 1`` of
its words, so its ``k + 1`` rarest are its keys and a window has one of them;
and all but ``k`` of the window's words occur in items of that length.  The benchmark is sent to the tasks in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm import textkit as tk


@dataclass(frozen=True)
class Settings:
    rate: float = 0.2  # word edits allowed, as a part of the item's words
    repeats: int = 48
    bits: int = 3
    stretch: int = 3  # output length of the walk, times the window
    min_words: int = 1  # shorter items are passed over; below 5 words no edit is allowed
    chunk_bytes: int = 4 << 20  # of text searched at a time in a task
    block_bytes: int = 4 << 20  # of benchmark text sent to the tasks at once
    cells: int = 1 << 21  # of a matrix of windows and their words that is held at a time


_SPACE = tk.SPACE
_DROP = np.zeros(256, bool)
_DROP[0:128] = True
_DROP[48:58] = False
_DROP[65:91] = False
_DROP[97:123] = False
_DROP &= ~_SPACE


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the normalised words and each document's range of them."""
    keep = ~_DROP[data]
    o = np.concatenate([[0], np.cumsum(keep)])[offs]
    d = data[keep]
    st, en, wo = tk.find_words(d, o)
    return tk.hash_words(d, st, en), wo


def samples(x: np.ndarray, length: int, s: Settings, rows: int = 1024) -> np.ndarray:
    """One key per row of ``x`` (a window of ``length`` words) and repeat: the
    sampled places of that repeat's CGK walk, hashed.  Past its end a window
    gives 0.  All repeats walk side by side."""
    rng = np.random.default_rng(1000 + length)
    places = np.sort(rng.integers(0, s.stretch * length, (s.repeats, s.bits)), axis=1)
    salts = rng.integers(0, 2**63, (s.stretch * length, s.repeats), dtype=np.uint64)
    keys = np.empty((len(x), s.repeats), np.uint64)
    for lo in range(0, len(x), rows):
        part = x[lo:lo + rows]
        n = len(part)
        pad = np.concatenate([part, np.zeros((n, 1), np.uint64)], axis=1).ravel()
        base = (np.arange(n, dtype=np.int64) * (length + 1))[:, None]
        i = np.zeros((n, s.repeats), np.int64)
        h = np.tile(np.arange(1, s.repeats + 1, dtype=np.uint64), (n, 1))
        for j in range(int(places.max()) + 1):
            c = pad[base + i]
            for r in np.flatnonzero((places == j).any(axis=1)):
                for _ in range(int((places[r] == j).sum())):
                    h[:, r] = tk.mix(h[:, r] * np.uint64(0xC2B2AE3D27D4EB4F) + c[:, r])
            i += ((c ^ salts[j]) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(63)).view(np.int64)
            np.minimum(i, length, out=i)
        keys[lo:lo + rows] = h
    return keys


def edits(item: np.ndarray, text: np.ndarray) -> int:
    """Least word edits that turn ``item`` into some stretch of ``text``."""
    row = np.zeros(len(text) + 1, np.int64)
    steps = np.arange(len(text) + 1)
    for i, w in enumerate(item):
        new = np.empty_like(row)
        new[0] = i + 1
        np.minimum(row[1:] + 1, row[:-1] + (text != w), out=new[1:])
        row = np.minimum.accumulate(new - steps) + steps
    return int(row.min())


#: Items of more words are verified in wide stretches, each once.
LONG = 256


class Bench:
    """One block of the benchmark, prepared for look-ups in the tasks."""

    def __init__(self, ids: list[int], texts: list[str], s: Settings):
        _, _, data, offs = next(tk.documents(pa.array(texts, pa.string()), 1 << 40))
        h, wo = words(data, offs)
        self.items = {}
        for k, i in enumerate(ids):
            w = h[wo[k]:wo[k + 1]]
            if len(w) >= s.min_words:
                self.items[k] = (i, w)
        self.sizes = sorted({len(w) for _, w in self.items.values()})
        self.vocab = np.unique(np.concatenate([w for _, w in self.items.values()])) if self.items else np.zeros(0, np.uint64)
        # a first test on 20 bits of the word hash, then the exact one
        self.gate = np.zeros(1 << 20, bool)
        self.gate[(self.vocab >> np.uint64(44)).astype(np.int64)] = True
        code = {k: np.searchsorted(self.vocab, w) for k, (_, w) in self.items.items()}
        common = np.zeros(len(self.vocab), np.int64)  # items that have the word
        for c in code.values():
            common[np.unique(c)] += 1
        self.any_key = np.zeros(len(self.vocab), bool)
        self.tables, self.codes, self.row = {}, {}, np.zeros(len(ids), np.int64)
        for n in self.sizes:
            own = [k for k, (_, w) in self.items.items() if len(w) == n]
            x = np.stack([self.items[k][1] for k in own])
            keys = samples(x, n, s)
            order = np.argsort(keys, axis=None, kind="stable")
            mine, key = np.zeros(len(self.vocab), bool), np.zeros(len(self.vocab), bool)
            for k in own:
                mine[code[k]] = True
                c = code[k][np.lexsort((code[k], common[code[k]]))]  # places of the item, rarest word first
                key[c[: int(s.rate * n) + 1]] = True
            self.any_key |= key
            self.codes[n] = np.stack([code[k] for k in own])
            self.row[own] = np.arange(len(own))
            self.tables[n] = (keys.ravel()[order], np.repeat(np.array(own), s.repeats)[order], mine, key)

    def find(self, h: np.ndarray, wo: np.ndarray, s: Settings) -> dict[tuple[int, int], int]:
        """Item and edits for each document (by its place) that holds the item."""
        found: dict[tuple[int, int], int] = {}
        self.looked: dict[tuple[int, int], list[tuple[int, int]]] = {}
        if not self.sizes or len(h) == 0:
            return found
        code = np.full(len(h), -1, np.int64)
        maybe = np.flatnonzero(self.gate[(h >> np.uint64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.vocab, h[maybe]), len(self.vocab) - 1)
        hit = self.vocab[at] == h[maybe]
        code[maybe[hit]] = at[hit]
        at_key = np.flatnonzero((code >= 0) & self.any_key[code])
        if len(at_key) == 0:
            return found
        bad = np.concatenate([[0], np.cumsum(code < 0, dtype=np.int32)])
        doc = np.searchsorted(wo, at_key, side="right") - 1
        mark = np.zeros(len(h), bool)
        for n in self.sizes:
            allow = int(s.rate * n)
            keys, owner, mine, key = self.tables[n]
            on = np.flatnonzero(key[code[at_key]])
            if not len(on):
                continue
            # windows of n words with a key; near a text's end they are shorter
            step = max(1, s.cells // n)
            for lo in range(0, len(on), step):
                some = on[lo:lo + step]
                start = (at_key[some][:, None] - np.arange(n)[None, :])
                first = wo[doc[some]][:, None]
                mark[start[start >= first]] = True
            start = np.flatnonzero(mark)
            mark[start] = False
            d = np.searchsorted(wo, start, side="right") - 1
            stop = np.minimum(start + n, wo[d + 1])
            ok = bad[stop] - bad[start] + (n - (stop - start)) <= allow
            start, stop, d = start[ok], stop[ok], d[ok]
            step = min(4096, max(1, s.cells // n)) if n <= LONG else 64
            for lo in range(0, len(start), step):
                self._match(h, wo, code, start[lo:lo + step], stop[lo:lo + step], d[lo:lo + step], n, allow, s, found)
        return found

    def _match(self, h, wo, code, start, stop, doc, n: int, allow: int, s: Settings, found: dict) -> None:
        keys, owner, mine, _ = self.tables[n]
        own = np.unique(owner).tolist()
        if n > LONG and len(own) <= 8:  # windows within stretches that were verified for every item of this length
            fresh = np.array([not all(any(a <= x <= z for a, z in self.looked.get((d, q), ())) for q in own)
                              for x, d in zip(start.tolist(), doc.tolist(), strict=True)], bool)
            start, stop, doc = start[fresh], stop[fresh], doc[fresh]
            if not len(start):
                return
        at = start[:, None] + np.arange(n)[None, :]
        inside = at < stop[:, None]
        at = np.minimum(at, len(h) - 1)
        c = code[at]
        good = ((c >= 0) & mine[c] & inside).sum(axis=1) >= n - allow
        if not good.any():
            return
        start, doc, at, inside = start[good], doc[good], at[good], inside[good]
        sig = samples(np.where(inside, h[at], np.uint64(0)), n, s, max(1, min(1024, s.cells // n)))
        lo = np.searchsorted(keys, sig, side="left")
        count = np.searchsorted(keys, sig, side="right") - lo
        r, rep = np.nonzero(count)
        if len(r) == 0:
            return
        times = count[r, rep]
        place = np.repeat(lo[r, rep] - np.cumsum(times) + times, times) + np.arange(times.sum())
        pairs = np.unique(np.repeat(r, times) * (1 << 32) + owner[place])
        pairs = np.stack([pairs >> 32, pairs & ((1 << 32) - 1)], axis=1)
        if n <= LONG:  # too few of the item's words near the window: not verified
            reach = np.arange(n + 2 * allow)[None, :] - allow
            enough = []
            step = min(512, max(1, 8 * s.cells // (n * (n + 2 * allow))))
            for p in range(0, len(pairs), step):
                i, q = pairs[p:p + step, 0], pairs[p:p + step, 1]
                near = start[i][:, None] + reach
                inside = (near >= wo[doc[i]][:, None]) & (near < wo[doc[i] + 1][:, None])
                near = np.where(inside, code[np.clip(near, 0, len(h) - 1)], -1)
                enough.append((self.codes[n][self.row[q]][:, :, None] == near[:, None, :]).any(axis=2).sum(axis=1) >= n - allow)
            pairs = pairs[np.concatenate(enough)]
        # windows of an item that overlap are verified together, a long item's in a wide stretch
        wide = n if n > LONG else 0
        pairs = pairs[np.lexsort((start[pairs[:, 0]], doc[pairs[:, 0]], pairs[:, 1]))]
        done: tuple[int, int, int] = (-1, -1, -1)
        for p, (i, q) in enumerate(pairs.tolist()):
            d, at = int(doc[i]), int(start[i])
            if found.get((d, q), n) == 0 or (done[:2] == (d, q) and at <= done[2]):
                continue
            last = at
            for j, r in pairs[p + 1:p + 1 + 4 * n].tolist():
                if r != q or doc[j] != d or start[j] - last > n or start[j] - at > 4 * n:
                    break
                last = int(start[j])
            done = (d, q, last + wide)
            a, b = max(int(wo[d]), at - wide - allow), min(int(wo[d + 1]), last + wide + n + allow)
            if wide:
                self.looked.setdefault((d, q), []).append((at - wide, last + wide))
                if np.isin(self.codes[n][self.row[q]], code[a:b]).sum() < n - allow:
                    continue
            dist = edits(self.items[q][1], h[a:b])
            if dist <= allow and dist < found.get((d, q), n):
                found[(d, q)] = dist


def _blocks(benchmark: DataFrame, s: Settings) -> Iterator[tuple[list[int], list[str]]]:
    """The benchmark in blocks of at most ``block_bytes`` of text (one item at least)."""
    ids, texts, size = [], [], 0
    rows = benchmark.where("item_id is not null and text is not null").select(
        F.col("item_id").cast("long"), F.col("text").cast("string")).orderBy("item_id", "text")
    for i, t in rows.toLocalIterator():
        b = len(t.encode())
        if ids and size + b > s.block_bytes:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(i)
        texts.append(t)
        size += b
    if ids:
        yield ids, texts


def contaminated(docs: DataFrame, benchmark: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``doc_id, item_id, edits, item_words`` for each document that holds an
    item (rows of clean documents do not appear).

    Whole texts are searched.  Null or empty texts hold nothing; items of any
    length are searched, those of fewer than five words without edits; items
    that are null or have no word (or fewer than ``min_words``) are never
    found; rows that repeat are reported once; a null doc_id is reported as
    null.  Extra columns are ignored; empty tables give an empty result."""
    schema = "doc_id long, item_id long, edits int, item_words int"
    out = docs.sparkSession.createDataFrame([], schema)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    for ids, texts in _blocks(benchmark, s):
        held = docs.sparkSession.sparkContext.broadcast(Bench(ids, texts, s))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            bench = held.value
            for batch in batches:
                rows = []
                doc = batch.column(0)
                for lo, _, data, offs in tk.documents(batch.column(1), s.chunk_bytes):
                    for (d, q), e in sorted(bench.find(*words(data, offs), s).items()):
                        rows.append((doc[lo + d].as_py(), bench.items[q][0], e, len(bench.items[q][1])))
                cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()),
                     pa.array(cols[3], pa.int32())], names=["doc_id", "item_id", "edits", "item_words"])

        out = out.unionByName(src.mapInArrow(run, schema))
    return out.groupBy("doc_id", "item_id").agg(F.min("edits").alias("edits"), F.max("item_words").alias("item_words"))


def clean(docs: DataFrame, benchmark: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item; rows and columns as they were.
    Decided row by row where the text is, so nothing is joined back.  Rows with a null or empty
    text stay, as do rows that repeat and rows with a null doc_id, by their text alone; columns
    may have any names; empty tables are fine."""
    names = docs.columns
    for ids, texts in _blocks(benchmark, s):
        held = docs.sparkSession.sparkContext.broadcast(Bench(ids, texts, s))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            bench = held.value
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for lo, _, data, offs in tk.documents(batch.column(len(names)), s.chunk_bytes):
                    for d, _ in bench.find(*words(data, offs), s):
                        keep[lo + d] = False
                yield batch.select(list(range(len(names)))).filter(pa.array(keep))

        plain, c = tk.numbered(docs)
        docs = plain.select("*", F.col(c["text"]).cast("string").alias("_text")).mapInArrow(run, docs.schema)
    return docs
