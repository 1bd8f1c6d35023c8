"""Bounded samples of labelled rows for the classifiers of this package."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.session import scratch_path


#: Fewest sampled rows of a class, unless it has under twice as many and half of them are there.
LEAST = 20


def labelled(docs: DataFrame, labels: DataFrame, label: str, train: DataFrame | F.Column) -> DataFrame:
    """``id, digest, bytes, copies, o, y``: one row for each labelled training
    id, however often it occurs, written as a table.

    Of several texts of one id the shortest stands for it (then the smallest
    digest); ``copies`` counts its rows and ``o`` is a hash of the id.  Rows
    without a label of 0 or 1 are left out; of several labels of one id the
    largest counts."""
    lab = (labels.where(F.col(label).isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("_id"))
           .agg(F.max(label).alias("y")))
    texts = keyed(docs.where(train)).groupBy("id", "digest", "bytes").agg(F.count(F.lit(1)).alias("copies"))
    one = texts.groupBy("id").agg(F.min(F.struct("bytes", "digest", "copies")).alias("t"))
    path = scratch_path(docs.sparkSession, "labelled")
    (one.join(lab, F.col("id") == F.col("_id"))
     .select("id", "t.digest", "t.bytes", "t.copies", F.xxhash64("id", F.lit(7)).alias("o"), F.col("y").cast("int").alias("y"))
     .write.parquet(path))
    return docs.sparkSession.read.parquet(path)


def keyed(docs: DataFrame, *columns: str) -> DataFrame:
    """``id, digest, bytes`` of each row's text (null: empty), and ``columns``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("id"), F.sha2(text, 256).alias("digest"),
                       F.octet_length(text).alias("bytes"), *columns)


def sample(docs: DataFrame, rows: DataFrame, label: str, train: DataFrame | F.Column, per_class: int,
           max_bytes: int, columns: list[str]) -> tuple[pd.DataFrame, dict[int, int]]:
    """At most ``per_class`` labelled training ids of each class with their
    texts, and the number of such ids of each class; ``rows`` is what
    :func:`labelled` gives.

    Ids are taken in the order of a hash, so the sample does not depend on the
    layout; ``max_bytes`` bounds the text that reaches the driver (per class),
    whole texts only: a text that does not fit what is left of it is skipped
    and the next ones are tried.  A class of which too little fits (``LEAST``)
    raises.  Rows that repeat are one."""
    totals = {int(r["y"]): int(r["n"]) for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    taken_of = []
    for y in sorted(totals):
        taken, left, after = [], max_bytes, F.lit(True)
        while len(taken) < per_class:  # a bounded top-k of the smallest hashes that can still fit
            want = per_class - len(taken)
            got = rows.where((F.col("y") == y) & (F.col("bytes") <= left) & after).orderBy("o", "id").limit(want).collect()
            for r in got:
                if r["bytes"] <= left:
                    taken.append((r["id"], r["digest"], y))
                    left -= r["bytes"]
            if len(got) < want:
                break
            last = got[-1]
            after = (F.col("o") > last["o"]) | ((F.col("o") == last["o"]) & (F.col("id") > last["id"]))
        if len(taken) < min(LEAST, per_class, totals[y] / 2):
            raise ValueError(f"only {len(taken)} of {totals[y]} texts with {label} = {y} fit {max_bytes} bytes")
        taken_of += taken
    if not taken_of:
        return pd.DataFrame({"doc_id": [], "y": [], **{c: [] for c in columns}}), totals
    # 2 x per_class rows; each is fetched once, by its exact text
    picked = docs.sparkSession.createDataFrame(taken_of, "pick long, pick_digest string, y int")
    found = keyed(docs.where(train).where(F.col("doc_id").isin([t[0] for t in taken_of])), *columns).join(
        F.broadcast(picked), (F.col("id") == F.col("pick")) & (F.col("digest") == F.col("pick_digest")))
    got = found.groupBy("id", "y").agg(F.min(F.struct(*columns)).alias("r")).select(F.col("id").alias("doc_id"), "r.*", "y").toPandas()
    return got.sort_values("doc_id").reset_index(drop=True), totals


def sums(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sums of consecutive segments along the first axis, each added up on its
    own, so equal segments give equal sums; empty ones give 0."""
    out = np.zeros((len(offs) - 1, *values.shape[1:]))
    some = np.flatnonzero(np.diff(offs) > 0)
    if len(some):
        out[some] = np.add.reduceat(values.astype(np.float64), offs[:-1][some], axis=0)
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))
