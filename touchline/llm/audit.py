"""Audit of how filters interact, by decision diagrams (operator 13).

Every document gets a mask of the filters it fails.  Spark counts documents by
part and mask; a part then has at most 2^filters rows, whatever its size, from
which a count-weighted decision diagram is built: a level per filter, the two
edges of a node lead on for documents that pass and that fail, equal nodes are
one, and every node knows the documents below it.  Orders of the filters are
walked so that each differs from the one before in two neighbouring filters;
the diagram follows by swapping those two levels.  In each order the path of
passing edges yields the steps: what the failing edge leaves to is removed,
what the passing edge leaves to is kept.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm import textkit as tk


@dataclass(frozen=True)
class Settings:
    least_words: int = 100  # A
    distinct_pct: int = 80  # B
    upper_pct: int = 10  # C
    signs: str = "#$%&*|"  # D


#: The filters; E (a text that a smaller doc_id holds too) needs the whole table.
FILTERS = "ABCDE"

_UPPER = bytes(range(65, 91))
_MORE = bytes(range(0x80, 0xC0))  # bytes that go on with a code point


# ---------------------------------------------------------------- documents
def own_failures(raw: bytes, s: Settings = Settings()) -> int:
    """Bits of the filters A to D that a text fails."""
    words = raw.split()  # at the bytes 0x20 and 0x09 to 0x0D
    n = len(words)
    points = len(raw.translate(None, _MORE))
    upper = len(raw) - len(raw.translate(None, _UPPER))
    return ((n < s.least_words) | (100 * len(set(words)) < s.distinct_pct * n) << 1
            | (100 * upper > s.upper_pct * points) << 2
            | (re.search(b"[" + re.escape(s.signs.encode()) + b"]", raw) is not None) << 3)


def _looked_at(s: Settings) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in b.column(2)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()),
                 pa.array([own_failures(t, s) for t in texts], pa.int32())], names=["doc_id", "part", "text_key", "fails"])
    return run


def masks(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``part, mask, n, good, toxic``: documents of each part by the filters
    they fail, and how many of them are labelled good or toxic.

    A text is known by its digest.  Rows of one text, part and labels are
    counted before texts meet, so many copies of a text are a few rows."""
    looked = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("lang").cast("string"), F.lit("")),
                         F.col("text").cast("string")).mapInArrow(
        _looked_at(s), "doc_id long, part string, text_key binary, fails int")
    marks = labels.where("quality = 1 or toxic = 1").groupBy(F.col("doc_id").alias("marked")).agg(
        F.max((F.coalesce("quality", F.lit(0)) == 1).cast("int")).alias("good"),
        F.max((F.coalesce("toxic", F.lit(0)) == 1).cast("int")).alias("toxic"))
    key = ["text_key", "fails", "part", "good", "toxic"]
    rows = looked.join(marks, F.col("doc_id") == F.col("marked"), "left").fillna(0, ["good", "toxic"])
    by_id = rows.groupBy(*key, "doc_id").agg(F.count(F.lit(1)).alias("n"))
    known = F.col("doc_id").isNotNull()
    by_text = by_id.groupBy(*key).agg(
        F.sum("n").alias("n"), F.min("doc_id").alias("low"),
        F.min(F.when(known, F.struct("doc_id", "n"))).alias("first"),
        F.sum(F.when(~known, F.col("n")).otherwise(0)).alias("nameless"))
    # rows of one text here: one for each part and labelling it occurs with
    lowest = F.min("low").over(Window.partitionBy("text_key"))
    by_text = by_text.withColumn("lowest", lowest)
    kept = F.col("nameless") + F.when(F.col("low") == F.col("lowest"), F.col("first.n")).otherwise(0)
    dup = F.lit(1 << FILTERS.index("E"))
    halves = F.explode(F.array(F.struct(F.col("fails").alias("mask"), kept.alias("n")),
                               F.struct(F.col("fails").bitwiseOR(dup).alias("mask"), (F.col("n") - kept).alias("n"))))
    cells = by_text.select("part", "good", "toxic", halves.alias("c"))
    n = F.col("c.n")
    return cells.where(n > 0).groupBy("part", F.col("c.mask").alias("mask")).agg(
        F.sum(n).alias("n"), F.sum(n * F.col("good")).alias("good"), F.sum(n * F.col("toxic")).alias("toxic"))


# ---------------------------------------------------------------- diagram
Weight = tuple[int, int, int]  # documents, good ones, toxic ones


class Diagram:
    """A reduced decision diagram with counts at its ends.  A node is a number;
    its two sides (pass, fail) and the documents below it are looked up.  Nodes
    of equal sides are one, so a swap of levels can share what it makes."""

    def __init__(self, names: str, counts: dict[int, Weight]) -> None:
        self.order = list(names)
        self.sides: list[tuple[int, int] | None] = []
        self.below: list[Weight] = []
        self._known: dict[object, int] = {}
        level = [self._end(counts.get(m, (0, 0, 0))) for m in range(1 << len(names))]
        for _ in names:  # the last filter is the mask's highest bit: its nodes are made first and lie lowest
            half = len(level) // 2
            level = [self._node(a, b) for a, b in zip(level[:half], level[half:], strict=True)]
        self.root = level[0]

    def _end(self, w: Weight) -> int:
        if ("end", w) not in self._known:
            self._known["end", w] = len(self.below)
            self.sides.append(None)
            self.below.append(w)
        return self._known["end", w]

    def _node(self, ok: int, fails: int) -> int:
        if (ok, fails) not in self._known:
            self._known[ok, fails] = len(self.below)
            self.sides.append((ok, fails))
            self.below.append(tuple(x + y for x, y in zip(self.below[ok], self.below[fails], strict=True)))
        return self._known[ok, fails]

    def swap(self, level: int) -> None:
        """Exchanges the filters of ``level`` and the one after it.  Nodes above
        are made anew along the way down, those below both stay."""
        done: dict[tuple[int, int], int] = {}

        def rebuilt(x: int, depth: int) -> int:
            if (x, depth) not in done:
                ok, fails = self.sides[x]
                if depth < level:
                    new = self._node(rebuilt(ok, depth + 1), rebuilt(fails, depth + 1))
                else:
                    (pp, pf), (fp, ff) = self.sides[ok], self.sides[fails]
                    new = self._node(self._node(pp, fp), self._node(pf, ff))
                done[x, depth] = new
            return done[x, depth]

        self.root = rebuilt(self.root, 0)
        self.order[level:level + 2] = self.order[level + 1], self.order[level]

    def steps(self) -> list[tuple[str, Weight, Weight]]:
        """Along the path of passing edges: filter, kept after it, removed by it."""
        out, x = [], self.root
        for name in self.order:
            ok, fails = self.sides[x]
            out.append((name, self.below[ok], self.below[fails]))
            x = ok
        return out


def neighbouring_orders(n: int) -> Iterator[int]:
    """Levels to swap, one after another, to go through all orders of ``n``:
    the largest element runs to and fro through the orders of the others."""
    if n < 2:
        return
    inner, down = neighbouring_orders(n - 1), True
    while True:
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        at = next(inner, None)
        if at is None:
            return
        yield at + 1 if down else at  # the largest is at one end, the others beside it
        down = not down


def steps_of_part(names: str, counts: dict[int, Weight]) -> list[tuple]:
    """Rows of all orders: order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley."""
    fails = {f: sum(w[0] for m, w in counts.items() if m >> i & 1) for i, f in enumerate(names)}
    only = {f: counts.get(1 << i, (0, 0, 0))[0] for i, f in enumerate(names)}
    d = Diagram(names, counts)
    rows, shapley = [], dict.fromkeys(names, 0)
    swaps = neighbouring_orders(len(names))
    while True:
        order = "".join(d.order)
        for k, (f, kept, removed) in enumerate(d.steps(), 1):
            shapley[f] += removed[0]
            rows.append((order, k, kept[0], removed[0], fails[f] - removed[0], only[f], removed[1], removed[2]))
        level = next(swaps, None)
        if level is None:
            return [(*r, shapley[r[0][r[1] - 1]]) for r in rows]
        d.swap(level)


# ---------------------------------------------------------------- operator
COLUMNS = ("part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
           "good_lost long, toxic_lost long, shapley long")


def _audited(group: pd.DataFrame) -> pd.DataFrame:
    counts = {int(m): (int(n), int(g), int(t)) for m, n, g, t in
              zip(group["mask"], group["n"], group["good"], group["toxic"], strict=True)}
    part = group["part"].iloc[0]
    return pd.DataFrame([(part, *r) for r in steps_of_part(FILTERS, counts)],
                        columns=[c.split()[0] for c in COLUMNS.split(", ")])


def interactions(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    """One row per part (``lang``), order of the five filters and step, with
    what the step's filter keeps, removes, finds removed already, fails alone,
    and loses of good and toxic documents.

    Null texts are empty (and equal to empty ones); empty texts fail A only, or
    E as well.  A null ``lang`` is the part ''.  Rows that repeat a doc_id each
    count; a text fails E if a smaller doc_id holds it, so rows with its
    smallest doc_id and rows without one do not.  Of several labels of one id
    the largest counts; ids without a label, or with a null one, are neither
    good nor toxic.  An empty table gives an empty result; extra columns are
    ignored."""
    return masks(docs, labels, s).groupBy("part").applyInPandas(_audited, COLUMNS)  # at most 32 rows a part


ORACLE = """
WITH d AS MATERIALIZED (SELECT doc_id, COALESCE(lang, '') AS part, COALESCE(text, '') AS t,
    regexp_extract_all(COALESCE(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
lab AS (SELECT doc_id, MAX(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, MAX(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY doc_id),
f AS (SELECT part, COALESCE(good, 0) AS good, COALESCE(toxic, 0) AS toxic,
    CASE WHEN len(w) < 100 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN d.doc_id > MIN(d.doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask
  FROM d LEFT JOIN lab ON lab.doc_id = d.doc_id),
h AS MATERIALIZED (SELECT part, mask, COUNT(*) AS n, SUM(good) AS good, SUM(toxic) AS toxic FROM f GROUP BY part, mask),
l AS (SELECT i, chr(CAST(65 + i AS INTEGER)) AS c FROM range(5) t(i)),
o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM l a, l b, l c, l d, l e
  WHERE (1 << a.i) + (1 << b.i) + (1 << c.i) + (1 << d.i) + (1 << e.i) = 31
    AND a.i <> b.i AND a.i <> c.i AND a.i <> d.i AND a.i <> e.i AND b.i <> c.i AND b.i <> d.i AND b.i <> e.i
    AND c.i <> d.i AND c.i <> e.i AND d.i <> e.i),
st AS (SELECT filter_order, step, 1 << (ascii(substr(filter_order, step, 1)) - 65) AS own,
    CAST(COALESCE(list_sum(list_transform(range(1, step), lambda k: 1 << (ascii(substr(filter_order, k, 1)) - 65))), 0) AS BIGINT) AS before
  FROM o, (SELECT CAST(i + 1 AS INTEGER) AS step FROM l)),
r AS (SELECT part, filter_order, step, own,
    SUM(CASE WHEN mask & (before | own) = 0 THEN n ELSE 0 END) AS kept,
    SUM(CASE WHEN mask & before = 0 AND mask & own <> 0 THEN n ELSE 0 END) AS removed,
    SUM(CASE WHEN mask & before <> 0 AND mask & own <> 0 THEN n ELSE 0 END) AS redundant,
    SUM(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
    SUM(CASE WHEN mask & before = 0 AND mask & own <> 0 THEN good ELSE 0 END) AS good_lost,
    SUM(CASE WHEN mask & before = 0 AND mask & own <> 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM h, st GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(SUM(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r
"""
