"""Block states kept up to date by match days (W-1..W-6).

The states that fixtures are scored with follow from little: of every key
(pair, home side, away side, team and season) the last five rows, and of every
team and season the totals by day.  A store holds these as tables cut into
buckets by key.  A new match day is merged into the buckets of its keys: the
old rings of these buckets and the day's rows give the new rings, so no match
of earlier days is read again.  Rings of other keys in these buckets are passed
on as they are.  Merging a day again changes nothing.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline.functions.columns import nz, season_year
from touchline.operators.asof import last_n_at
from touchline.operators.ledger import team_ledger
from touchline.plans import features as fe
from touchline.plans.summaries import known_teams
from touchline.schema import LAST_N, SEASON_START_MONTH

D = fe.D
SEASON = ["team", "season_year"]
SMALL_DAY = 1_000_000  # rows up to which a day is sent to the tasks that hold the store


def _totals(matches: DataFrame) -> DataFrame:
    """Season sums of each team by day."""
    sums, _ = fe._league_aggs()
    return team_ledger(matches).groupBy(*SEASON, D).agg(*[a.alias(n) for n, a in sums.items()])


#: Ring -> (rows from matches, key).
RINGS: dict[str, tuple[Callable[[DataFrame], DataFrame], list[str]]] = {
    "A": (fe._h2h_rows, ["lo", "hi"]),
    "B": (lambda m: fe._form_rows(m, fe.HOME), ["team"]),
    "C": (lambda m: fe._form_rows(m, fe.AWAY), ["team"]),
    "E": (team_ledger, SEASON),
}


@dataclass
class StateStore:
    """Rings and season totals below ``path``, in ``buckets`` parts each."""
    spark: SparkSession
    path: str
    buckets: int = 64

    def _bucketed(self, rows: DataFrame, keys: list[str]) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(self.buckets)).cast("int"))

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def _write(self, rows: DataFrame, name: str, mode: str) -> None:
        (rows.repartition("bucket").write.mode(mode).option("partitionOverwriteMode", "dynamic")
         .partitionBy("bucket").parquet(f"{self.path}/{name}"))

    @staticmethod
    def build(history: DataFrame, path: str, buckets: int = 64) -> StateStore:
        """A store of a whole history: the only step that reads it."""
        store = StateStore(history.sparkSession, path, buckets)
        for name, (rows, keys) in RINGS.items():
            store._write(store._bucketed(_latest(rows(history), keys), keys), name, "overwrite")
        store._write(store._bucketed(_totals(history), SEASON), "totals", "overwrite")
        return store

    def merged(self, name: str, day: DataFrame) -> DataFrame:
        """The new content of the buckets that ``day`` touches."""
        if name == "totals":
            new, keys, same = _totals(day), SEASON, [*SEASON, D]
        else:
            rows, keys = RINGS[name]
            new, same = rows(day), [*keys, "match_id"]
        new = self._bucketed(new, keys)
        per = new.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()  # at most ``buckets`` rows
        small = sum(r["n"] for r in per) <= SMALL_DAY
        sent = F.broadcast if small else (lambda df: df)
        old = self._read(name).where(F.col("bucket").isin([r["bucket"] for r in per]))
        kept = old.join(sent(new.select(*same)), same, "left_anti")  # rows delivered again are replaced
        if name == "totals":
            return kept.unionByName(new)
        asked = new.select(*[F.col(k).alias(f"_k_{k}") for k in keys]).distinct()
        met = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
        rings = _latest(kept.join(sent(asked), met, "left_semi").unionByName(new), keys)
        return old.join(sent(asked), met, "left_anti").unionByName(rings)

    def add(self, day: DataFrame) -> None:
        """Merge matches that were not there yet, or deliver days again.  A day's
        matches come whole: its season totals are replaced, not added to."""
        for name in [*RINGS, "totals"]:
            self._write(self.merged(name, day), name, "overwrite")

    def saved(self, at: dt.date | None = None, start_month: int = SEASON_START_MONTH) -> fe.SavedStates:
        """The block states on the day after the last match (or a later one)."""
        last = self._read("A").agg(F.max(D)).first()[0]  # one scalar
        at = at or last + dt.timedelta(days=1)
        if at <= last:
            raise ValueError(f"the store knows matches up to {last}; its states are of later days")
        ring = lambda name: self._read(name).drop("bucket")
        _, recent = fe._league_aggs()
        season = F.col("season_year") == season_year(F.lit(at).cast("date"), start_month)
        sums = ring("totals").where(season).groupBy(*SEASON).agg(
            *[F.sum(c).alias(c) for c in fe._league_aggs()[0]]).withColumn(D, F.lit(at).cast("date"))
        blocks = {"A": last_n_at(ring("A"), ["lo", "hi"], fe._h2h_aggs(), at),
                  "E": sums.join(last_n_at(ring("E").where(season), SEASON, recent, at).drop(D), SEASON)}
        for name, side in (("B", fe.HOME), ("C", fe.AWAY)):
            st = last_n_at(ring(name), ["team"], fe._form_aggs(), at, lag_cols=["pts"])
            blocks[name] = st.select("team", D, nz(F.col("n")).alias("_n"), *fe._form_features(side))
        teams = known_teams(ring("A").select(F.col("lo").alias("home_team"), F.col("hi").alias("away_team")))
        return fe.SavedStates(at, blocks, teams)


def _latest(rows: DataFrame, keys: list[str], n: int = LAST_N) -> DataFrame:
    """The last rows of each key: a partial limit before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(F.col(D).desc(), F.col("match_id").desc())
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")
