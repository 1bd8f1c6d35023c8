"""Exact top-k inner products by a pivot-distance index (operator 2).

Vectors are whole numbers.  One more coordinate lifts every vector x to the
same length R (the largest norm), and a query q, with 0 there, is at squared
distance |q|^2 + R^2 - 2 q.x from it: the largest products are the smallest
distances, so the triangle inequality can prune.

Index: each vector is keyed by its nearest pivot and its distance from it, cut
into annuli; an annulus of many vectors is cut into blocks.  Search: a query
visits the annulus nearest its own distance around its nearest pivot, and
expands annuli outwards until it holds k results; that fixes its k-th score.
An annulus [lo, hi] of pivot p can hold a result no further than the k-th
distance t only if lo - t <= d(q, p) <= hi + t; exactly the annuli that pass
this bound are visited, and all others are done with.

Equal vectors are one entry with their smallest ids, as many as any answer can
use (k + 1, as a query leaves itself out); the bounds carry a margin for
rounding, and scores are exact integer products.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.session import scratch_path


@dataclass(frozen=True)
class Settings:
    k: int = 5
    scale: float = 256.0
    pivots: int = 64
    fit_rows: int = 4096  # vectors the pivots are chosen from
    rings: int = 32  # annuli of a pivot
    block: int = 2048  # vectors of a block, on average
    queries: int = 512  # queries that meet a block at once
    batch: int = 16384  # queries that come to a block's task, on average


def quantised(vectors: DataFrame, s: Settings) -> DataFrame:
    """``id, v`` (array of long) of the vectors that take part: not null, with
    no null or non-finite component, and with an id."""
    x = F.col("embedding")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return vectors.where(F.col("vec_id").isNotNull() & x.isNotNull() & F.coalesce(fine, F.lit(False))).select(
        F.col("vec_id").cast("long").alias("id"),
        F.transform(x, lambda c: F.floor(c.cast("double") * F.lit(s.scale)).cast("long")).alias("v"))


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), dim).astype(np.float64)


def choose_pivots(sample: np.ndarray, n: int, rounds: int = 8) -> np.ndarray:
    """Pivots by k-means on a bounded sample of lifted vectors."""
    if len(sample) <= n:
        return sample
    rng = np.random.default_rng(7)
    p = sample[rng.choice(len(sample), n, replace=False)].copy()
    for _ in range(rounds):
        near = distances(sample, p).argmin(axis=1)
        for i in range(n):
            if (near == i).any():
                p[i] = sample[near == i].mean(axis=0)
    return p


def distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    d = (x * x).sum(axis=1)[:, None] + (p * p).sum(axis=1)[None, :] - 2.0 * (x @ p.T)
    return np.sqrt(np.maximum(d, 0.0))


def _lift(x: np.ndarray, r2: float) -> np.ndarray:
    return np.concatenate([x, np.sqrt(np.maximum(r2 - (x * x).sum(axis=1), 0.0))[:, None]], axis=1)


def _score_blocks(s: Settings, dim: int, most: int):
    """Per block of the index and batch of queries: each query's k best.
    Products are exact: of doubles while all sums stay below 2^53, else of
    64-bit integers."""
    fast = dim * most * most < 1 << 53

    def product(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        if fast:
            return np.rint(x @ y.T).astype(np.int64)
        return x.astype(np.int64) @ y.astype(np.int64).T

    def run(queries: pa.Table, block: pa.Table) -> pa.Table:
        names = ["qid", "id", "score"]
        if queries.num_rows == 0 or block.num_rows == 0:
            return pa.table({n: pa.array([], pa.int64()) for n in names})
        ids, x = block["id"].to_numpy(), _matrix(block["v"], dim)
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        out: list[np.ndarray] = []
        for lo in range(0, queries.num_rows, s.queries):
            part = queries.slice(lo, s.queries)
            qid, low = part["qid"].to_numpy(), part["low"].to_numpy()
            score = product(_matrix(part["v"], dim), x)
            none = np.iinfo(np.int64).min
            score[ids[None, :] == qid[:, None]] = none  # a query leaves itself out
            if score.shape[1] > s.k:
                top = np.partition(score, score.shape[1] - s.k, axis=1)[:, -s.k]
            else:
                top = np.full(len(qid), none)
            r, c = np.nonzero((score >= np.maximum(top, low)[:, None]) & (score > none))
            v = score[r, c]
            o = np.lexsort((ids[c], -v, r))
            r, c, v = r[o], c[o], v[o]
            first = np.searchsorted(r, r)
            best = np.arange(len(r)) - first < s.k
            out.append(np.stack([qid[r[best]], ids[c[best]], v[best]]))
        got = np.concatenate(out, axis=1)
        return pa.table({n: pa.array(got[i], pa.int64()) for i, n in enumerate(names)})
    return run


def _best(rows: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc("id"))
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search(vectors: DataFrame, is_query, s: Settings = Settings()) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each vector that ``is_query``
    (a condition on ``vec_id``) names, the ``k`` largest inner products with
    all other vectors (all, if fewer), ties to the smaller vec_id.

    Null vectors, vectors with a null or non-finite component and vectors
    without an id take no part.  A vector that is shorter than the longest
    counts as followed by zeros, so an empty one has the product 0 with all.
    Rows that repeat a vec_id: the query leaves out every row of its own id,
    and equal rows count once.  An empty table gives an empty result; extra
    columns are ignored.  Components so large that a product might not fit a
    long raise."""
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score long"
    path = scratch_path(spark, "topk-vectors")
    quantised(vectors, s).write.parquet(path)
    rows = spark.read.parquet(path)
    stats = rows.agg(F.max(F.size("v")).alias("dim"), F.min(F.size("v")).alias("least"), F.max(F.greatest(
        F.array_max("v"), -F.greatest(F.coalesce(F.array_min("v"), F.lit(0)), F.lit(-(2**62))))).alias("most"), F.max(F.aggregate(
            "v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))).alias("r2")).first()
    if stats["dim"] is None:
        return spark.createDataFrame([], schema)
    dim, r2, most = max(1, stats["dim"]), float(stats["r2"]), stats["most"] or 0
    if dim * most * most >= 1 << 63:
        raise ValueError(f"components up to {most}: products of {dim} of them may not fit a long")
    if stats["least"] < dim:
        rows = rows.select("id", F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(dim) - F.size("v"))).alias("v"))
    # equal vectors: their smallest ids, aggregated before any of them meet
    w = Window.partitionBy("v").orderBy("id")
    uniq = rows.distinct().withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= s.k + 1).drop("_r")
    sample = rows.orderBy(F.xxhash64("id")).limit(s.fit_rows).select("v").toPandas()
    pivots = choose_pivots(_lift(np.array(sample["v"].tolist(), float).reshape(-1, dim), r2), s.pivots)
    held = spark.sparkContext.broadcast(pivots)  # a fixed number of pivots
    # the lifted distances of a pivot lie between 0 and 2 R
    step = 2.0 * np.sqrt(r2) / (4 * s.rings) if r2 > 0 else 1.0

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = distances(_lift(_matrix(b.column(1), dim), r2), held.value)
            near = d.argmin(axis=1)
            own = d[np.arange(len(d)), near]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(near.astype(np.int32)), pa.array((own / step).astype(np.int32)),
                 pa.array(own)], names=["id", "v", "pivot", "ring", "dist"])

    placed = uniq.mapInArrow(place, "id long, v array<long>, pivot int, ring int, dist double")
    index_path = scratch_path(spark, "topk-index")
    placed.write.parquet(index_path)
    index = spark.read.parquet(index_path)
    rings = index.groupBy("pivot", "ring").agg(F.min("dist").alias("lo"), F.max("dist").alias("hi"),
                                               F.count(F.lit(1)).alias("n"))
    ring_path = scratch_path(spark, "topk-rings")
    rings.write.parquet(ring_path)
    # pivots x rings rows at most, whatever the size of the table
    table = sorted((r["pivot"], r["ring"], r["lo"], r["hi"], r["n"]) for r in spark.read.parquet(ring_path).collect())
    cells = np.array(table, float)
    cell_of = spark.sparkContext.broadcast(cells)
    blocks = np.maximum(1, np.ceil(cells[:, 4] / s.block)).astype(np.int64)

    def visits(batches: Iterator[pa.RecordBatch], first: bool) -> Iterator[pa.RecordBatch]:
        """Cells that each query visits: at first those nearest until they hold
        enough, later all others that its k-th distance cannot rule out."""
        c = cell_of.value
        for b in batches:
            x = _matrix(b.column(1), dim)
            low = b.column(2).to_numpy(zero_copy_only=False)
            qd = distances(np.concatenate([x, np.zeros((len(x), 1))], axis=1), held.value)
            d = qd[:, c[:, 0].astype(int)]
            gap = np.maximum(np.maximum(c[:, 2][None, :] - d, d - c[:, 3][None, :]), 0.0)
            home = qd.argmin(axis=1)
            out_q, out_c = [], []
            norm = (x * x).sum(axis=1)
            for i in range(len(x)):
                # the annuli around the nearest pivot come first, then those with the smallest gap
                order = np.lexsort((gap[i], c[:, 0] != home[i]))
                enough = np.searchsorted(np.cumsum(c[order, 4]), s.k + 1) + 1
                seen = order[:enough]
                if first:
                    pick = seen
                else:
                    t = np.sqrt(max(0.0, norm[i] + r2 - 2.0 * low[i])) + 1e-6 * (1.0 + np.sqrt(r2))
                    pick = np.flatnonzero(gap[i] <= t)
                    pick = np.setdiff1d(pick, seen, assume_unique=True)
                out_q.append(np.full(len(pick), i))
                out_c.append(pick)
            q, cell = np.concatenate(out_q), np.concatenate(out_c)
            take = pa.array(q)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(take), b.column(1).take(take), b.column(2).take(take), pa.array(cell.astype(np.int64))],
                names=["qid", "v", "low", "cell"])

    number = F.broadcast(spark.createDataFrame(  # one row per annulus, as above
        [(int(r[0]), int(r[1]), i, int(n)) for i, (r, n) in enumerate(zip(table, blocks.tolist(), strict=True))],
        "pivot int, ring int, cell long, blocks long"))
    stored = index.join(number, ["pivot", "ring"]).select(
        "id", "v", "cell", F.pmod(F.xxhash64("id"), "blocks").alias("part"))
    out_schema = "qid long, id long, score long"

    def meet(queries: DataFrame, first: bool) -> DataFrame:
        spread = queries.mapInArrow(lambda it: visits(it, first), "qid long, v array<long>, low long, cell long")
        spread = spread.join(F.broadcast(number.select("cell", "blocks")), "cell").withColumn(
            "part", F.explode(F.expr("sequence(0L, blocks - 1)"))).drop("blocks").withColumn(
            "turn", F.pmod(F.xxhash64("qid"), F.lit(batches)))
        # a block comes once for each batch of queries, so that both sides of a group are bounded
        turns = stored.withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(batches - 1).cast("long"))))
        key = ["cell", "part", "turn"]
        return spread.groupBy(*key).cogroup(turns.groupBy(*key)).applyInArrow(_score_blocks(s, dim, most), out_schema)

    least = F.lit(-(2**62)).cast("long")
    asked = rows.withColumnRenamed("id", "vec_id").where(is_query).select(
        F.col("vec_id").alias("qid"), "v").distinct().withColumn("low", least)
    batches = max(1, -(-asked.count() // s.batch))
    near_path = scratch_path(spark, "topk-near")
    _best(meet(asked, True), s.k).write.parquet(near_path)
    near = spark.read.parquet(near_path)
    kth = near.where(F.col("rank") == s.k).select("qid", F.col("score").alias("kth"))
    bound = asked.join(kth, "qid", "left").select("qid", "v", F.coalesce("kth", least).alias("low"))
    far = meet(bound, False)
    both = near.select("qid", "id", "score").unionByName(far).distinct()
    return _best(both, s.k).select(F.col("qid").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, x.vec_id,
    CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(x.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v x ON q.vec_id <> x.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
