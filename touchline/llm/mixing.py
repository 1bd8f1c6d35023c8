"""Mixing sources to target weights by pivotal dependent rounding (operator 5).

Each source has a target number of words; a document of it is due
``target / source size`` copies, which is a whole part (0, 1 or 2) and a
fraction.  The fractions are made whole by the pivotal method: two documents
meet, and mass (fraction times words, so that words are conserved) moves from
one to the other until one of the two is whole, in a direction drawn so that
expectations are kept.  What is left of one meets the next.  This runs in
parallel: each group of a source leaves at most one unfinished document, and
a reduction tree combines these residuals until one is left per source; it is
rounded last, so a source misses its target by less than one document.  Long
documents meet first, so what is left over at the end is mostly a short one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm import textkit as tk
from touchline.session import scratch_path

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
SHARE = 1.5  # of all words
MOST = 2  # copies of a source at most
GROUP = 2048  # documents of a group, on average
FAN = 64  # residuals that meet in one node of the tree
SEED = 20240229


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``source, source_size, target`` from rows ``(source, source_size)``.

    Sources stand in code-point order, null last, and weigh ``weights`` in
    turn.  Water-filling: each gets its weighted part of the total, what is
    above ``most`` times its size is cut and shared again among the others.
    One row per source; each round moves only three sums to the driver."""
    order = Window.orderBy(F.col("source").isNull(), F.encode(F.col("source"), "UTF-8"))
    rank = (F.row_number().over(order) - 1) % len(weights)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), rank + 1)
    t = sizes.select("source", "source_size", w.alias("weight"))
    total = t.agg(F.sum("source_size")).first()[0] or 0
    cap = F.col("source_size") * F.lit(float(most))
    level = 0.0
    while True:
        full = F.col("weight") * F.lit(level) >= cap
        s = t.agg(F.sum(F.when(full, cap).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        left, open_weight = share * total - (s[0] or 0.0), s[1] or 0.0
        new = left / open_weight if open_weight > 0 else level
        if new <= level * (1 + 1e-15):
            break
        level = new
    return t.select("source", "source_size", F.least(F.col("weight") * F.lit(level), cap).alias("target"))


def _draw(x: np.ndarray, salt: int) -> np.ndarray:
    """Uniform numbers in [0, 1) from 64-bit keys."""
    with np.errstate(over="ignore"):
        h = tk.mix(x.view(np.uint64) + np.uint64(salt) * np.uint64(0x9E3779B97F4A7C15))
    return (h >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def pivot(size: np.ndarray, part: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Fractions after the pivotal pass over one group, in the given order:
    all 0 or 1 but at most one, with ``sum(size * part)`` unchanged."""
    out = part.astype(float).copy()
    hold = -1
    for i in range(len(out)):
        p, s = out[i], float(size[i])
        if s <= 0 or p <= 1e-12 or p >= 1 - 1e-12:
            out[i] = 1.0 if p >= 0.5 and s > 0 else 0.0
            continue
        if hold < 0:
            hold = i
            continue
        a, b = out[hold] * float(size[hold]), p * s
        up = min(float(size[hold]) - a, b)  # the held one gains
        down = min(a, s - b)  # the held one gives
        if u[i] * (up + down) < down:
            a, b = a + up, b - up
        else:
            a, b = a - down, b + down
        qa, qb = a / float(size[hold]), b / s
        ra, rb = min(qa, 1 - qa) <= 1e-9, min(qb, 1 - qb) <= 1e-9
        out[hold] = round(qa) if ra else qa
        out[i] = round(qb) if rb else qb
        hold = (-1 if rb else i) if ra else hold
    return out


def _rounds(level: int, final: bool):
    """Arrow function over rows sorted by (source, group, order): settles each group."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        at = None

        def settle(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(rows).combine_chunks()
            key = t["key"].to_numpy()
            size, part = t["size"].to_numpy(), t["part"].to_numpy()
            u = _draw(key, SEED + level)
            p = pivot(size, part, u)
            if final:
                i = np.flatnonzero((p > 0) & (p < 1))
                p[i] = (_draw(key[i], SEED + 1000) < p[i]).astype(float)
            t = t.set_column(t.column_names.index("part"), "part", pa.array(p))
            yield from t.to_batches()

        for batch in batches:
            g = batch.column(batch.schema.get_field_index("node")).to_numpy(zero_copy_only=False)
            if len(g) == 0:
                continue
            cuts = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist(), len(g)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if at is not None and g[lo] != at:
                    yield from settle(held)
                    held = []
                at = g[lo]
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from settle(held)
    return run


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, size, source_size, target, copies,
    taken`` and ``row_key`` (hash of id, source and text).

    ``size`` is the text's number of words (null: 0), ``copies`` how often the
    mix takes the document (0 to ``most``), ``taken = copies * size``.
    Texts without words are never taken.  A null source is a source of its
    own, last in order.  Rows that repeat are rounded one by one, and of equal
    rows any may be taken.  All draws are hashes of the rows, so reruns agree.
    An empty table gives an empty result; extra columns are ignored.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "mix-sizes")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                       tk.word_count("text").alias("size"),
                       F.xxhash64(F.col("doc_id"), F.col("source"), F.col("text")).alias("row_key"))
    base.write.parquet(path)
    base = spark.read.parquet(path)
    # equal rows are one entry with a count: their whole copies are known at once
    same = base.groupBy("doc_id", "source", "size", "row_key").agg(F.count(F.lit(1)).alias("m"))
    per = same.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"),
                                     F.count(F.lit(1)).alias("n"))
    goal = targets(per.select("source", "source_size"), weights, share, most).withColumnRenamed("source", "_s")
    goal = goal.join(per.select(F.col("source").alias("_p"), "n"), F.col("_s").eqNullSafe(F.col("_p"))).drop("_p")
    due = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(due + F.lit(1e-12)).cast("long")
    extra = F.greatest(due - whole, F.lit(0.0)) * F.col("m")
    rows = same.join(goal, same["source"].eqNullSafe(goal["_s"])).select(
        "doc_id", "source", "size", "row_key", "m", "source_size", "target", whole.alias("whole"),
        F.floor(extra + F.lit(1e-12)).cast("long").alias("more"),
        F.greatest(extra - F.floor(extra + F.lit(1e-12)), F.lit(0.0)).alias("part"),
        F.greatest(F.ceil(F.col("n") / GROUP), F.lit(1)).cast("long").alias("groups"))
    rows = rows.withColumn("key", F.xxhash64("row_key", "size", F.lit(SEED)))
    rows = rows.withColumn("grp", F.pmod(F.xxhash64("key"), F.col("groups")))
    rows = rows.withColumn("node", F.xxhash64("source", F.lit("level0"), "grp"))
    schema = ("doc_id long, source string, size long, row_key long, m long, source_size long, target double, "
              "whole long, more long, part double, groups long, key long, grp long, node long")
    level, parts = 0, []
    most_groups = per.agg(F.max("n")).first()[0] or 0
    width = max(1, -(-most_groups // GROUP))
    while True:
        final = width <= 1
        out = (rows.repartition("node").sortWithinPartitions("node", F.desc("size"), "key", "doc_id")
               .mapInArrow(_rounds(level, final), schema))
        path = scratch_path(spark, f"mix-level{level}")
        out.write.parquet(path)
        out = spark.read.parquet(path)
        open_ = (F.col("part") > 0) & (F.col("part") < 1)
        parts.append(out if final else out.where(~open_))
        if final:
            break
        level += 1
        rows = out.where(open_).withColumn("grp", F.expr(f"grp div {FAN}")) \
            .withColumn("node", F.xxhash64("source", F.lit(f"level{level}"), "grp"))
        width = -(-width // FAN)
    done = parts[0]
    for p in parts[1:]:
        done = done.unionByName(p)
    # back to rows: the first of equal rows carry the extra copies
    each = done.withColumn("_block", F.explode(F.expr("sequence(0L, (m - 1) div 65536)"))).withColumn(
        "_i", F.explode(F.expr("sequence(_block * 65536, least(m, (_block + 1) * 65536) - 1)")))
    copies = F.col("whole") + (F.col("_i") < F.col("more") + F.col("part").cast("long")).cast("long")
    return each.select("doc_id", "size", "source_size", "target", copies.alias("copies"),
                       (copies * F.col("size")).alias("taken"), "row_key")


def mixed(docs: DataFrame, **kw) -> DataFrame:
    """``docs`` with each row repeated as often as the mix takes it."""
    m = mix(docs, **kw).where("copies > 0").groupBy("row_key").agg(F.sum("copies").alias("_copies"))
    # equal rows share a key: one of them stands for all, with the sum of their copies
    m = m.select(F.col("row_key").alias("_row_key"), "_copies")
    plain, c = tk.numbered(docs)
    keyed = plain.withColumn("_row_key", F.xxhash64(*[F.col(c[x]) for x in ("doc_id", "source", "text")]))
    one = keyed.dropDuplicates(["_row_key"]).join(m, "_row_key")  # rows repeated in full are one before the join
    return (one.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
            .select(*[F.col(n).alias(x) for x, n in c.items()]))
