"""Training features from saved, bucketed states (JN-3, JN-4, UQ-2).

Each block's per-day states and the matches' narrow probes are written once,
both bucketed by the block's key and day, so a probe meets its state without
being shuffled, by any number of later jobs.  What travels on to the stitch by
``match_id`` are whole-number sums and counts; ratios and interactions are
computed after the last join and move nowhere.
"""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.functions.columns import outcome_label
from touchline.plans import features as fe
from touchline.schema import H2H_NAMES, INTERACTION_NAMES, LEAGUE_NAMES, feature_names
from touchline.session import scratch_path

D = fe.D
KEYS = fe.KEYS
raw_state = fe.raw_state
probes = fe.block_probes


@dataclass(frozen=True)
class TrainingStates:
    """Names of the saved tables: states and probes by block."""
    spark: SparkSession
    states: dict[str, str]
    probes: dict[str, str]
    parts: int = 0  # partitions of the stitch; 0: the session's


def _bucketed(df: DataFrame, keys: list[str], buckets: int, name: str) -> str:
    table = f"touchline_{name}_{uuid.uuid4().hex[:12]}"
    (df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys)
     .option("path", scratch_path(df.sparkSession, table)).saveAsTable(table))
    return table


def save_training_states(history: DataFrame, buckets: int | None = None) -> TrainingStates:
    """Write states and probes of all blocks, bucketed alike by key and day: at
    least 64 buckets, and one for every ``features.STITCH_ROWS`` matches.  The
    blocks are written side by side.

    A day before which its key has no rows gets no state (blocks A, B, C): a
    probe that meets none has the same features, those of a count of 0."""
    buckets = buckets or max(64, history.count() // fe.STITCH_ROWS)

    def save(block: str) -> tuple[str, str]:
        on, state = [*KEYS[block], D], raw_state(history, block)
        state = state if block == "E" else state.where(F.col("n") > 0)
        return (_bucketed(state, on, buckets, f"state_{block}"),
                _bucketed(probes(history, block), on, buckets, f"probe_{block}"))

    with ThreadPoolExecutor(max_workers=len(KEYS)) as pool:
        made = dict(zip(KEYS, pool.map(save, KEYS), strict=True))
    return TrainingStates(history.sparkSession, {b: s for b, (s, _) in made.items()}, {b: p for b, (_, p) in made.items()},
                          fe.stitch_parts(history))


def _stitched(saved: TrainingStates) -> DataFrame:
    """One row per match: label, home side, and each block's sums as a struct."""
    out = None
    for block, keys in KEYS.items():
        on = [*keys, D]
        state, probe = saved.spark.table(saved.states[block]), saved.spark.table(saved.probes[block])
        sums = F.struct(*[F.col(c) for c in state.columns if c not in on]).alias(f"sums_{block}")
        state = state.select(*on, sums)
        carried = [c for c in probe.columns if c not in on]
        part = probe.join(state, on, "left").select(*carried, *(["lo"] if block == "A" else []), f"sums_{block}")
        part = part.repartition(saved.parts, "match_id") if saved.parts else part
        out = part if out is None else out.join(part, "match_id", "left")
    return out


def training_features(saved: TrainingStates, fix_away_efficiency: bool = False) -> DataFrame:
    """As ``features.training_features``, from saved states."""
    out = _stitched(saved)
    out = fe.expanded(out, "A").drop("lo", "home_team")
    for block in ("B", "C", "E"):
        out = fe.expanded(out, block)
    out = out.select("*", *fe.interaction_features(fix_away_efficiency))
    assert {*H2H_NAMES, *LEAGUE_NAMES, *INTERACTION_NAMES} <= set(out.columns)
    out = out.where((F.col("_nA") + F.col("_nB") + F.col("_nC")) > 0)  # PF-10
    return out.select("match_id", *feature_names(), outcome_label("ftr").alias("outcome"))
