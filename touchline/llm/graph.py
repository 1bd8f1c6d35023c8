"""Connected components of a distributed edge list (alternating stars)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.session import checkpoint_dir


#: Edges that one task contracts at a time.
TASK_EDGES = 200_000


class Union:
    """Union-find whose roots are the smallest members."""

    def __init__(self) -> None:
        self.up: dict = {}

    def find(self, x):
        up = self.up
        root = x
        while (y := up.get(root, root)) != root:
            root = y
        while x != root:
            up[x], x = root, up.get(x, x)
        return root

    def join(self, x, y) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        low, high = (x, y) if x < y else (y, x)
        self.up.setdefault(low, low)
        self.up[high] = low
        return True


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of one task as stars around the smallest nodes."""
    sets, names, kind = Union(), ["u", "v"], None
    for batch in batches:
        kind = batch.schema.field(0).type
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            sets.join(x, y)
    if kind is not None:
        nodes = [x for x in sets.up if sets.find(x) != x]
        yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([sets.find(x) for x in nodes], kind)], names=names)


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of the undirected edge list; ``root`` is
    the smallest node of its component (the root itself is listed too).

    First each task contracts its own edges (``TASK_EDGES`` or so) to stars by
    union-find.  If there is more than one task, rounds over all of them
    follow: each hangs every larger neighbour onto a node's smallest neighbour
    (large star), then every smaller neighbour likewise (small star); the
    rounds grow with the logarithm of a component's size.  Edges stay in Spark
    tables; each round is cut by ``checkpoint()`` into the shared folder, and
    only a count and a checksum reach the driver.  The smallest neighbours are
    a table of their own before edges join them, so Spark can split the join
    at a node with many neighbours.
    Null ends are ignored; an empty edge list gives an empty result.
    """
    checkpoint_dir(edges.sparkSession)
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")) \
        .where("u is not null and v is not null and u <> v")
    tasks = max(1, -(-e.count() // TASK_EDGES))
    e = e.coalesce(tasks).mapInArrow(_contract, e.schema).checkpoint()
    seen = None
    for _ in range(rounds if tasks > 1 else 0):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).checkpoint()
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = large.checkpoint()
        low = large.groupBy("u").agg(F.min("v").alias("m")).checkpoint()
        small = large.join(low, "u")
        e = (small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
             .unionByName(low.select("u", F.col("m").alias("v"))).distinct().checkpoint())
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == tuple(now):
            break
        seen = tuple(now)
    else:
        if tasks > 1:
            raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
