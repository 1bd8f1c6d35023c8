"""Centroid clustering in whole numbers with PCA-rotated filtering (operator 11).

Vectors are scaled to integers.  A rotation onto the principal axes, found
from the sums of products over all vectors, gives each vector its leading
coordinates and the length of what is left; both are stored beside it.  For a
vector and a centroid, the squared distance of the leading coordinates plus
the squared difference of the two lengths is never more than the squared
distance, so centroids whose bound lies above the best distance are done with.
The others are measured in integers, so the result is exact and does not
depend on rounding in the rotation, for which the bounds leave a margin.

Each round is one pass over the stored table: tasks send the sums of their
vectors by centroid, Spark adds them up, and ``k`` rows reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.session import scratch_path

#: Integer components below this keep every squared distance of 64 of them within 63 bits.
MOST = 1 << 27


@dataclass(frozen=True)
class Settings:
    k: int = 8
    rounds: int = 10
    dim: int = 64
    scale: float = 1024.0
    lead: int = 16  # rotated coordinates that are stored
    seed: int = 3


def quantised(vectors: DataFrame, s: Settings) -> DataFrame:
    """``vec_id, v`` (array of int) of the vectors that take part; components
    are held within ``MOST``, which :func:`cluster` refuses to go beyond."""
    x = F.col("embedding")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    kept = vectors.where((F.size(x) == s.dim) & F.coalesce(fine, F.lit(False)))
    whole = F.transform(x, lambda c: F.greatest(F.lit(-MOST), F.least(
        F.lit(MOST), F.floor(c.cast("double") * F.lit(s.scale)))).cast("int"))
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"))


def _rows(col: pa.Array, width: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), width)


def _lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    offs = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(rows.reshape(-1), kind))


# ---------------------------------------------------------------- rotation
@dataclass(frozen=True)
class Rotation:
    mean: np.ndarray
    axes: np.ndarray  # columns, by falling variance
    lead: int

    def place(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leading coordinates and the length of the rest, from all coordinates."""
        y = (v.astype(np.float64) - self.mean) @ self.axes
        return y[:, :self.lead], np.sqrt((y[:, self.lead:] ** 2).sum(axis=1))


def rotation(rows: DataFrame, s: Settings) -> Rotation:
    """Principal axes from the sums of products over all vectors.  Tasks send
    one matrix each; its rows are added up by Spark."""
    d = s.dim + 1  # a leading 1 gives the count and the sums as well

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for b in batches:
            x = np.ones((b.num_rows, d))
            x[:, 1:] = _rows(b.column(0), s.dim)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), _lists(total, pa.float64())], names=["i", "p"])

    sums = rows.select("v").mapInArrow(products, "i int, p array<double>").groupBy("i").agg(
        F.array(*[F.sum(F.col("p")[j]) for j in range(d)]).alias("p"))
    m = np.array([r["p"] for r in sums.orderBy("i").collect()])  # dim + 1 rows
    n, mean = m[0, 0], m[0, 1:] / m[0, 0]
    _, axes = np.linalg.eigh(m[1:, 1:] / n - np.outer(mean, mean))
    return Rotation(mean, axes[:, ::-1], min(s.lead, s.dim))


# ---------------------------------------------------------------- assignment
def nearest(v: np.ndarray, lead: np.ndarray, rest: np.ndarray, centroids: np.ndarray,
            turn: Rotation) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid of each integer vector (ties to the smaller number),
    its squared distance, and how many centroids were measured in integers."""
    clead, crest = turn.place(centroids)
    size, csize = (lead ** 2).sum(axis=1) + rest ** 2, (clead ** 2).sum(axis=1) + crest ** 2
    bound = ((lead ** 2).sum(axis=1)[:, None] + (clead ** 2).sum(axis=1)[None, :] - 2.0 * (lead @ clead.T)
             + (rest[:, None] - crest[None, :]) ** 2)
    bound -= 1e-9 * (size[:, None] + csize[None, :]) + 1e-3
    v = v.astype(np.int64)

    def measured(rows: np.ndarray, c: np.ndarray) -> np.ndarray:
        diff = v[rows] - centroids[c]
        return np.einsum("ij,ij->i", diff, diff)

    every = np.arange(len(v))
    best = bound.argmin(axis=1)
    dist = measured(every, best)
    first, checked = best.copy(), np.ones(len(v), np.int32)
    for c in range(len(centroids)):
        rows = np.flatnonzero((bound[:, c] <= dist) & (first != c))
        if len(rows):
            d = measured(rows, c)
            checked[rows] += 1
            better = (d < dist[rows]) | ((d == dist[rows]) & (c < best[rows]))
            rows, d = rows[better], d[better]
            best[rows], dist[rows] = c, d
    return best, dist, checked


def _sums(index: DataFrame, centroids: np.ndarray, turn: Rotation, s: Settings) -> dict[int, tuple[int, list[int]]]:
    """Count and component sums of each centroid's vectors: at most ``k`` rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), s.dim), np.int64)
        for b in batches:
            v = _rows(b.column(1), s.dim)
            c, _, _ = nearest(v, _rows(b.column(2), turn.lead), b.column(3).to_numpy(), centroids, turn)
            n += np.bincount(c, minlength=len(centroids))
            for i in np.unique(c):
                total[i] += v[c == i].sum(axis=0, dtype=np.int64)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some.astype(np.int32)), pa.array(n[some]), _lists(total[some], pa.int64())], names=["c", "n", "s"])

    wide = "decimal(38,0)"  # no overflow, however many vectors
    parts = index.mapInArrow(run, "c int, n long, s array<long>").groupBy("c").agg(
        F.sum("n").alias("n"), F.array(*[F.sum(F.col("s")[j].cast(wide)) for j in range(s.dim)]).alias("s"))
    return {r["c"]: (r["n"], [int(x) for x in r["s"]]) for r in parts.collect()}


def cluster(vectors: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256,
    checked``: every vector that takes part with its centroid after ``rounds``
    rounds; ``checked`` counts the centroids measured for it in the last pass.

    Null vectors, vectors of another length than ``dim``, and those with a null
    or non-finite component take no part.  Fewer vectors than ``k`` give as
    many centroids.  Rows that repeat each take part and give a row, and may
    each be a first centroid; a null vec_id counts as the empty text in the
    order of first centroids.  An empty table gives an empty result; extra
    columns are ignored.  An integer component of ``MOST`` or more (an
    embedding component of 131,072) raises, as distances would not fit a long."""
    spark = vectors.sparkSession
    path = scratch_path(spark, "centroid-vectors")
    quantised(vectors, s).write.parquet(path)
    rows = spark.read.parquet(path)
    most = rows.agg(F.max(F.greatest(F.array_max("v"), -F.array_min("v")))).first()[0]
    if most is None:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, "
                                         "centroid_sha256 string, checked int")
    if most >= MOST:
        raise ValueError(f"integer components of {MOST} or more")
    name = F.concat(F.lit(f"{s.seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    firsts = rows.orderBy(F.sha2(name, 256), "vec_id", "v").limit(s.k).collect()  # k rows
    centroids = np.array([r["v"] for r in firsts], np.int64)

    turn = rotation(rows, s)

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lead, rest = turn.place(_rows(b.column(1), s.dim))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _lists(lead, pa.float64()), pa.array(rest)],
                                             names=["vec_id", "v", "lead", "rest"])

    path = scratch_path(spark, "centroid-index")
    rows.mapInArrow(store, "vec_id long, v array<int>, lead array<double>, rest double").write.parquet(path)
    index = spark.read.parquet(path)
    for _ in range(s.rounds):
        for c, (n, total) in _sums(index, centroids, turn, s).items():
            centroids[c] = [t // n for t in total]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c, d, checked = nearest(_rows(b.column(1), s.dim), _rows(b.column(2), turn.lead), b.column(3).to_numpy(),
                                    centroids, turn)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(c.astype(np.int32)), pa.array(d), pa.array(checked)],
                                             names=["vec_id", "cluster", "distance", "checked"])

    path = scratch_path(spark, "centroid-rows")
    index.mapInArrow(assign, "vec_id long, cluster int, distance long, checked int").write.parquet(path)
    done = spark.read.parquet(path)
    sums = {r["cluster"]: int(r["d"]) for r in done.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}  # k rows
    about = spark.createDataFrame(
        [(c, d, sum(sums.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest())
         for c, d in sums.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return done.join(F.broadcast(about), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "checked")


def oracle(s: Settings = Settings()) -> str:
    """The same clusters in SQL: every vector against every centroid."""
    def nearest_sql(c: str) -> str:
        return (f"(SELECT k.rid, k.vec_id, k.v, {c}.c, {c}.m, CAST(list_sum(list_transform(range(1, {s.dim + 1}), "
                f"lambda i: (k.v[i] - {c}.m[i]) * (k.v[i] - {c}.m[i]))) AS BIGINT) AS d FROM kept k, {c} "
                "QUALIFY row_number() OVER (PARTITION BY k.rid ORDER BY d, c) = 1)")
    sql = f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id,
    list_transform(embedding, lambda x: CAST(floor({s.scale:g} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = {s.dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (
    ORDER BY sha256('{s.seed}:' || COALESCE(CAST(vec_id AS VARCHAR), '')), vec_id, v) - 1 AS c, v AS m
  FROM kept QUALIFY c < {s.k})"""
    for r in range(s.rounds):
        sql += f""",
s{r} AS MATERIALIZED (SELECT c, i, SUM(v[i]) AS t, COUNT(*) AS n FROM {nearest_sql(f'c{r}')}, range(1, {s.dim + 1}) r(i) GROUP BY c, i),
m{r} AS MATERIALIZED (SELECT c, list(CAST((t - ((t % n) + n) % n) // n AS BIGINT) ORDER BY i) AS m FROM s{r} GROUP BY c),
c{r + 1} AS MATERIALIZED (SELECT c{r}.c, COALESCE(m{r}.m, c{r}.m) AS m FROM c{r} LEFT JOIN m{r} ON m{r}.c = c{r}.c)"""
    return sql + f""",
a AS MATERIALIZED (SELECT * FROM {nearest_sql(f'c{s.rounds}')})
SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(SUM(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
  CAST(SUM(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(list_transform(m, lambda x: CAST(x AS VARCHAR)), ',')) AS centroid_sha256 FROM a
"""
