"""SimHash near-duplicates through a byte-position inverted index (operator 12).

A text's fingerprint has 64 bits, eight bytes; two fingerprints that differ in
at most four bits differ in at most four bytes, so they share a byte at four
or more of the eight positions.  The index posts each distinct fingerprint
under its bytes at a few sets of positions; the sets are chosen so that any
four positions hold one of them, so every pair to be linked meets in a list.
In a list the shared positional bytes of each pair are tallied, pairs below
the guaranteed minimum are dropped, and the rest are verified bit by bit.

What bounds the work:

* equal fingerprints are one entry, so copies cost nothing beyond a count;
* the sets hold two, three or four positions by the number of entries, so that
  lists stay short on average;
* a list of over ``meet`` entries is posted again under one more position; a
  list that is too long even under four positions is cut into blocks, and each
  pair of blocks meets in a task of its own;
* a list gives the links of a spanning forest, not all its pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm import graph
from touchline.llm import textkit as tk
from touchline.session import scratch_path

BYTES = 8
U64 = np.uint64


@dataclass(frozen=True)
class Settings:
    words: int = 4  # words of a shingle
    bits: int = 4  # most differing bits of a link, 4 or less
    seed: int = 42
    meet: int = 4096  # entries that meet whole
    mean_list: int = 64  # entries of a list, on average, beyond which sets get one more position

    @property
    def shared(self) -> int:
        """Bytes that a linked pair shares at least."""
        return BYTES - self.bits


# ---------------------------------------------------------------- fingerprints
def plain(raw: np.ndarray) -> bytes:
    """The words of a text, lower-cased, with one space between."""
    if len(raw) == 0:
        return b""
    low = tk.LOWER[raw]
    gap = tk.SPACE[low]
    low[gap] = 32
    keep = ~gap
    keep[1:] |= ~gap[:-1]  # white space that follows a word
    return low[keep].tobytes().strip(b" ")


def fingerprint(raw: np.ndarray, s: Settings = Settings(), step: int = 1 << 15) -> int:
    """The bits that over half of a text's shingle hashes have; 0 without words."""
    text = plain(raw)
    if not text:
        return 0
    gaps = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
    shingles = max(1, len(gaps) + 2 - s.words)
    tally = np.zeros(64, np.int64)
    digest, seed = xxhash.xxh64_intdigest, s.seed
    for lo in range(0, shingles, step):
        hi = min(shingles, lo + step)
        starts = (gaps[max(lo, 1) - 1:hi - 1] + 1).tolist()
        starts = starts if lo else [0, *starts]
        ends = gaps[lo + s.words - 1:hi + s.words - 1].tolist()
        ends += [len(text)] * (len(starts) - len(ends))
        h = np.array([digest(text[a:b], seed) for a, b in zip(starts, ends, strict=True)], U64)
        tally += np.unpackbits(h.view(np.uint8).reshape(-1, BYTES), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * tally > shingles, bitorder="little").view(U64)[0])


def _prints(s: Settings) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offs = tk.buffers(b.column(1))
            at = offs.tolist()
            fp = np.array([fingerprint(raw[x:y], s) for x, y in zip(at, at[1:])], U64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])
    return run


def fingerprints(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``doc_id, fp``: every row's fingerprint as a signed 64-bit number."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        _prints(s), "doc_id long, fp long")


# ---------------------------------------------------------------- index
def cover(width: int) -> list[int]:
    """Sets of ``width`` byte positions, as bit masks, such that any four of
    the eight positions hold one of them.  The positions are dealt into three
    groups; of any four, two share a group, and three lie in one group or two
    in one and one in the next."""
    groups = [(0, 1, 2), (3, 4, 5), (6, 7)]
    if width == 2:
        sets = [p for g in groups for p in combinations(g, 2)]
    elif width == 3:
        sets = [t for g in groups for t in combinations(g, 3)]
        sets += [(*p, x) for i, g in enumerate(groups) for p in combinations(g, 2) for x in groups[(i + 1) % 3]]
    else:
        sets = list(combinations(range(BYTES), 4))
    return sorted(sum(1 << p for p in t) for t in sets)


def finer(at: int) -> list[int]:
    """Sets with one more position than ``at``: four shared positions that hold
    ``at`` hold one of them, as at most three of the others are passed over."""
    rest = [p for p in range(BYTES) if not at >> p & 1]
    return [at | 1 << p for p in rest[:5]]


def _signed(at: int) -> int:
    """The bytes of a set of positions as a mask over a signed 64-bit number."""
    m = sum(0xFF << 8 * p for p in range(BYTES) if at >> p & 1)
    return m - (1 << 64) if m >> 63 else m


def _post(entries: DataFrame, sets: list[int]) -> DataFrame:
    """``at, key, fp``: each entry under its bytes at every set of positions."""
    where = F.explode(F.array(*[F.struct(F.lit(a).alias("at"), F.lit(_signed(a)).alias("mask")) for a in sets]))
    return entries.select("fp", where.alias("w")).select(
        F.col("w.at").alias("at"), F.col("fp").bitwiseAND(F.col("w.mask")).alias("key"), "fp")


def _lists(entries: DataFrame, s: Settings) -> list[DataFrame]:
    """Tables ``at, key, part, fp`` whose lists hold every pair to be linked,
    each of bounded length."""
    spark = entries.sparkSession
    n = entries.count()
    width = next((w for w in (2, 3) if n <= s.mean_list * 256 ** w), 4)
    posted, out = _post(entries, cover(width)), []
    while True:
        path = scratch_path(spark, "simhash-long")
        posted.groupBy("at", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > s.meet).write.parquet(path)
        long = spark.read.parquet(path)
        if long.isEmpty():
            return [*out, posted.withColumn("part", F.lit(0))]
        out.append(posted.join(long, ["at", "key"], "left_anti").withColumn("part", F.lit(0)))
        held = posted.join(long, ["at", "key"])
        if width == 4:
            return [*out, _block_pairs(held, s)]
        steps = spark.createDataFrame([(a, b, _signed(b)) for a in range(256) if a.bit_count() == width for b in finer(a)],
                                      "at int, finer int, mask long")  # at most 56 sets of five each
        path = scratch_path(spark, "simhash-finer")
        (held.join(F.broadcast(steps), "at")
         .select(F.col("finer").alias("at"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
         .distinct().write.parquet(path))
        posted, width = spark.read.parquet(path), width + 1


def _block_pairs(held: DataFrame, s: Settings) -> DataFrame:
    """Long lists cut into blocks of about half ``meet``; every pair of a list's
    blocks is a list of its own."""
    blocks = F.ceil(F.col("n") * 2 / s.meet).cast("int")
    cut = held.withColumn("blocks", blocks).withColumn(
        "block", F.pmod(F.xxhash64("fp", F.lit(s.seed)), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    pair = F.least("block", "other") * F.col("blocks") + F.greatest("block", "other") + 1
    return cut.withColumn("other", other).where("block <> other").select("at", "key", pair.alias("part"), "fp")


_LOW7 = U64(0x7F7F7F7F7F7F7F7F)


def shared_bytes(x: np.ndarray) -> np.ndarray:
    """Zero bytes of each number, i.e. equal bytes of the two it is the xor of."""
    return np.bitwise_count(~(((x & _LOW7) + _LOW7) | x | _LOW7))


def _root(up: np.ndarray, x: int) -> int:
    while up[x] != x:
        up[x] = up[up[x]]
        x = up[x]
    return x


def list_links(group: np.ndarray, fp: np.ndarray, s: Settings) -> tuple[list[int], list[int]]:
    """Places of linked entries of the same group: a spanning forest of them.
    ``group`` numbers the lists, rows of a list are together."""
    n = len(fp)
    up = np.arange(n)
    left, right = [], []
    at = np.arange(n)
    for d in range(1, n):
        at = at[at < n - d]
        at = at[group[at] == group[at + d]]
        if not len(at):
            break
        x = fp[at] ^ fp[at + d]
        tallied = shared_bytes(x) >= s.shared
        a = at[tallied][np.bitwise_count(x[tallied]) <= s.bits]
        a = a[up[a] != up[a + d]]
        if len(a):
            for p in a.tolist():
                i, j = _root(up, p), _root(up, p + d)
                if i != j:
                    up[max(i, j)] = min(i, j)
                    left.append(p)
                    right.append(p + d)
            while not np.array_equal(up, up[up]):
                up = up[up]
    return left, right


def _meet(s: Settings) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Links of the lists of a task; rows come sorted by list."""
    def links(keys: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        new = np.ones(len(fp), bool)
        new[1:] = (keys[:, 1:] != keys[:, :-1]).any(axis=0)
        left, right = list_links(np.cumsum(new), fp, s)
        ends = [pa.array(fp[np.array(e, np.int64)].view(np.int64)) for e in (left, right)]
        return pa.RecordBatch.from_arrays(ends, names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fp = np.zeros((3, 0), np.int64), np.zeros(0, U64)
        for b in batches:
            keys = np.concatenate([keys, np.stack([b.column(i).to_numpy().astype(np.int64) for i in range(3)])], axis=1)
            fp = np.concatenate([fp, b.column(3).to_numpy().view(U64)])
            open_from = int(np.argmax((keys == keys[:, -1:]).all(axis=0))) if len(fp) else 0
            if open_from:  # the last list may go on in the next batch
                yield links(keys[:, :open_from], fp[:open_from])
                keys, fp = keys[:, open_from:], fp[open_from:]
        if len(fp) > 1:
            yield links(keys, fp)
    return run


def links(entries: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``a, b``: links between distinct fingerprints (``fp``) that connect all
    that are at most ``bits`` apart."""
    lists = _lists(entries, s)
    rows = lists[0].select("at", "key", "part", "fp")
    for more in lists[1:]:
        rows = rows.unionByName(more.select("at", "key", "part", "fp"))
    order = ["at", "key", "part"]
    return rows.repartition(*order).sortWithinPartitions(*order, "fp").mapInArrow(_meet(s), "a long, b long")


# ---------------------------------------------------------------- operator
def near_duplicates(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``doc_id, fingerprint, component_id, kept``: every row with its
    fingerprint (16 hex digits), the smallest doc_id that links lead to, and
    whether that is its own.

    A null or empty text, or one of white space only, has fingerprint zero and
    is linked like any other.  A text of fewer words than a shingle is one
    shingle.  Rows that repeat (a doc_id, a text or both) each give a row; rows
    without a doc_id take part, but are never the smallest, and their
    component_id is null if no linked row has one.  An empty table gives an
    empty result; extra columns are ignored."""
    if not 0 <= s.bits <= 4:
        raise ValueError("bits must be 0 to 4")
    spark = docs.sparkSession

    def written(df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(spark, name)
        df.write.parquet(path)
        return spark.read.parquet(path)

    prints = written(fingerprints(docs, s), "simhash-prints")
    entries = written(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-entries")
    roots = graph.components(written(links(entries.select("fp"), s), "simhash-links"))
    member = written(entries.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root")), "simhash-members")
    # the smallest id of a component is a table of its own, so that the joins can split a large one
    least = written(member.groupBy("root").agg(F.min("low").alias("component_id")), "simhash-least")
    named = written(member.join(least, "root").select("fp", "component_id"), "simhash-named")
    return prints.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))
