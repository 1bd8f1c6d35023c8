"""Many fits as one Spark job, and their held-out scores as another.

The rows a search fits on are sent to the tasks once, up to ``task_rows`` of
them; every fit of a batch of trials, folds and members is a row of a table, and
Spark runs one task for each, the longest first.  Fitted members come back as
rows too.  They meet the held-out rows, all of them, by trial, fold and block of
rows, so neither models nor rows pass through the driver.  With more rows they
stay in many tasks (``large``), and the votes are fitted one after another.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.functions.ship import ensure_package
from touchline.learners import codes as cd
from touchline.learners import held as hm
from touchline.learners import large
from touchline.learners import members as mb
from touchline.session import scratch_path

NO_FOLD = -1
SCORE_ROWS = 50_000  # held-out rows of a block


@dataclass
class Sample:
    """Rows that a task can hold: codes, class, key and fold."""
    codes: np.ndarray
    y: np.ndarray
    key: np.ndarray
    fold: np.ndarray

    def without(self, fold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        pick = self.fold != fold if fold != NO_FOLD else slice(None)
        return self.codes[pick], self.y[pick], self.key[pick]

    @staticmethod
    def of(rows: DataFrame, width: int) -> Sample:
        """Collects ``key, outcome, codes`` (and ``fold``); the caller bounds the rows.  They
        are put in order of key, so a fit does not depend on how the table is stored."""
        have = "fold" in rows.columns
        t = rows.select("key", "outcome", "codes", *(["fold"] if have else [])).toArrow()
        key = t["key"].to_numpy().astype(np.int64).view(np.uint64)
        order = np.argsort(key, kind="stable")
        fold = t["fold"].to_numpy() if have else np.full(len(key), NO_FOLD)
        return Sample(cd.unpacked(t["codes"], width)[order], t["outcome"].to_numpy().astype(np.int64)[order], key[order], fold[order])


@dataclass(frozen=True)
class Job:
    trial: int
    fold: int
    member: str
    params: mb.VoteParams
    first: int = 0
    upto: int = 0

    @property
    def cost(self) -> float:
        share = (self.upto - self.first) / self.params.tree_n_estimators if self.member == "tree" else 1.0
        return mb.cost(self.member, self.params) * share


def jobs_of(trial: int, fold: int, p: mb.VoteParams, trees_a_task: int | None = None) -> list[Job]:
    """The fits of one vote; the forest in parts of ``trees_a_task`` trees."""
    step = trees_a_task or p.tree_n_estimators
    return [Job(trial, fold, "tree", p, lo, min(p.tree_n_estimators, lo + step)) for lo in range(0, p.tree_n_estimators, step)] \
        + [Job(trial, fold, m, p) for m in ("xgb", "cat")]


FITTED = "trial int, fold int, member string, part int, blob binary, importance array<double>"


def fitted(spark: SparkSession, sample: Broadcast, jobs: list[Job]) -> DataFrame:
    """``trial, fold, member, part, blob, importance`` of every job: one task each."""
    ensure_package(spark)
    order = sorted(jobs, key=lambda j: -j.cost)
    table = spark.createDataFrame(
        [(i, j.trial, j.fold, j.member, j.first, j.upto, json.dumps(j.params.plain())) for i, j in enumerate(order)],
        "place int, trial int, fold int, member string, first int, upto int, params string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                x, y, key = sample.value.without(r["fold"])
                p = mb.VoteParams(**json.loads(r["params"]))
                weight = None
                if r["member"] == "tree":
                    made, imp = mb.fit_forest(x, y, key, p, r["first"], r["upto"])
                    weight = imp.tolist()
                else:
                    made = large.fit_booster(r["member"], x, y, key, p)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["trial"]], pa.int32()), pa.array([r["fold"]], pa.int32()), pa.array([r["member"]]),
                     pa.array([r["first"]], pa.int32()), pa.array([mb.to_bytes(made)], pa.binary()),
                     pa.array([weight], pa.list_(pa.float64()))],
                    names=["trial", "fold", "member", "part", "blob", "importance"])

    return table.repartitionById(len(order), F.col("place")).mapInArrow(run, FITTED)


def member_of(parts: list[dict]) -> dict[str, mb.Member]:
    """The members of one vote from their rows (``member, part, blob``)."""
    out: dict[str, mb.Member] = {}
    for name in mb.MEMBERS:
        own = sorted((p for p in parts if p["member"] == name), key=lambda p: p["part"])
        if own:
            out[name] = mb.joined([mb.from_bytes(p["blob"]) for p in own])
    return out


def held_out_scores(models: DataFrame, votes: list[tuple[int, int]], rows: DataFrame, width: int, blocks: int) -> DataFrame:
    """``trial, fold, n, correct``: every fitted vote (trial and fold) on all rows of its fold.

    ``rows`` has ``key, outcome, fold, codes``.  Rows of a fold are dealt into
    ``blocks``; a vote meets a block in one group, so a group is one vote and a
    bounded number of rows."""
    block = F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int")
    fitted_votes = models.select("trial", "fold", "member", "part", "blob").withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = rows.sparkSession.createDataFrame(votes, "trial int, fold int")  # a row per trial and fold
    held = rows.select("fold", "outcome", "codes", block.alias("block")).join(F.broadcast(asked), "fold")

    def score(vote: pa.Table, part: pa.Table) -> pa.Table:
        empty = vote.num_rows == 0 or part.num_rows == 0
        n = correct = 0
        if not empty:
            p = mb.vote(member_of(vote.select(["member", "part", "blob"]).to_pylist()), cd.unpacked(part["codes"], width))
            n, correct = len(p), int((p.argmax(axis=1) == part["outcome"].to_numpy()).sum())
        src = part if vote.num_rows == 0 else vote
        return pa.table({"trial": pa.array([src["trial"][0].as_py()], pa.int32()), "fold": pa.array([src["fold"][0].as_py()], pa.int32()),
                         "n": pa.array([n], pa.int64()), "correct": pa.array([correct], pa.int64())})

    key = ["trial", "fold", "block"]
    met = fitted_votes.groupBy(*key).cogroup(held.groupBy(*key)).applyInArrow(score, "trial int, fold int, n long, correct long")
    return met.groupBy("trial", "fold").agg(F.sum("n").alias("n"), F.sum("correct").alias("correct"))


@dataclass
class Folds:
    """Coded training rows with folds, written once, and those that fits use."""
    rows: DataFrame  # key, outcome, fold, codes
    sample: Broadcast | None  # of what fits use, if a task can hold it
    fits: DataFrame  # the same rows
    width: int
    folds: int
    blocks: int
    node_rows: int

    @staticmethod
    def of(train: DataFrame, features: list[str], folds: int, fit_rows: int | None, cuts: np.ndarray | None = None,
           task_rows: int = 200_000, node_rows: int = 100_000) -> Folds:
        """``train`` has ``match_id, outcome, fold`` and the features.  Each fit
        uses all rows outside its fold, or about ``fit_rows`` of them drawn by a
        hash of the match id, if that is given; every row is scored."""
        from touchline.plans.prep import portable_hash
        spark = train.sparkSession
        ensure_package(spark)
        cuts = cd.cut_points(train, features) if cuts is None else cuts
        path = scratch_path(spark, "coded-folds")
        cd.with_codes(train, features, cuts, ["match_id", "outcome", "fold"]).select(
            F.col("match_id").cast("long").alias("key"), "outcome", "fold", "codes").write.parquet(path)
        rows = spark.read.parquet(path)
        n = rows.count()
        most = None if fit_rows is None else fit_rows * folds / max(1, folds - 1)
        drawn = rows if most is None or n <= most else rows.where(portable_hash("key", 7) < int(most / n * 2147483648))
        used = n if drawn is rows else drawn.count()
        held = spark.sparkContext.broadcast(Sample.of(drawn, len(features))) if used <= task_rows else None
        return Folds(rows, held, drawn, len(features), folds, max(1, -(-n // (folds * SCORE_ROWS))), node_rows)

    def scores(self, votes: list[tuple[int, int, mb.VoteParams]]) -> DataFrame:
        """``trial, fold, n, correct`` of (trial, fold, parameters) triples: fits
        them as one job, writes the members and scores all held-out rows."""
        spark = self.rows.sparkSession
        if self.sample is None:
            return spark.createDataFrame([(t, f, *self._score(f, p)) for t, f, p in votes],  # a row per trial and fold
                                         "trial int, fold int, n long, correct long")
        path = scratch_path(spark, "search-members")
        fitted(spark, self.sample, [j for t, f, p in votes for j in jobs_of(t, f, p)]).write.parquet(path)
        return held_out_scores(spark.read.parquet(path), [(t, f) for t, f, _ in votes], self.rows, self.width, self.blocks)

    def _score(self, fold: int, p: mb.VoteParams) -> tuple[int, int]:
        """Rows of a fold, and how many of them a vote gets right that is fitted on the others in many tasks."""
        own = self.fits.where(F.col("fold") != fold)
        counts = {r["outcome"]: r["n"] for r in own.groupBy("outcome").agg(F.count(F.lit(1)).alias("n")).collect()}
        members = large.fit_members(own, self.width, p, sum(counts.values()), counts, self.node_rows)
        held = hm.HeldMembers.of(self.rows.sparkSession, members)
        try:
            return held.accuracy(self.rows.where(F.col("fold") == fold), self.width)
        finally:
            held.unsent()
