"""Plan-shape guards for the registered queries (design rules, not values)."""

import datetime

import pytest

from pyspark.sql import functions as F

import __spark_entry__ as E
from tests.conftest import SF_SMALL
from touchline.schema import MATCH_COLUMNS

#: Queries that fit models; the corpus queries have tests of their own.
MODEL_KEYS = {"feature_importance", "top_features", "importance_report", "cv_score", "search_trials", "best_model"}


def _fits(name: str) -> bool:
    return name in MODEL_KEYS or name.startswith(("vote_", "forest_", "boost_", "score_")) or name == "pipeline" \
        or (name[:2] == "op" and name[2].isdigit())


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(n for n in E.queries() if not _fits(n)))
def test_no_cross_products(spark, name):
    plan = _plan(E.queries()[name](spark, SF_SMALL))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, plan


@pytest.mark.parametrize("name", ["h2h_features", "home_form", "away_form", "league_form", "pair_matches",
                                  "home_record", "last5_both"])
def test_history_blocks_limit_before_shuffle(spark, name):
    plan = _plan(E.queries()[name](spark, SF_SMALL))
    # the day tails run as a partial WindowGroupLimit on the map side and a
    # final one after the exchange, so a hot key moves at most 5 rows per day
    assert plan.count("WindowGroupLimit") >= 2, plan


def test_scans_are_pruned(spark):
    df = E.queries()["home_form"](spark, SF_SMALL)
    scans = [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines()
             if "FileScan parquet" in line]
    assert scans
    for line in scans:
        schema = line.split("ReadSchema: ")[1] if "ReadSchema: " in line else ""
        assert "away_team" not in schema, line   # block B never reads the away side


def test_saved_states_need_few_exchanges(spark):
    """With broadcasts off: only the stitch by match_id moves rows, and no ratio or interaction among them."""
    from touchline.plans import saved
    from touchline.plans.features import training_features
    from touchline.sources import adapter
    history = adapter.landed_matches(spark, SF_SMALL)
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        states = saved.save_training_states(history, 8)
        got = saved.training_features(states)
        plan = got._jdf.queryExecution().executedPlan().toString()
        exchanges = [line for line in plan.splitlines() if "Exchange " in line]
        assert 0 < len(exchanges) <= 4 and all("match_id" in line for line in exchanges)
        stitched = saved._stitched(states).columns
        assert sorted(stitched) == sorted(["match_id", "lo", "home_team", "ftr", *[f"sums_{b}" for b in "ABCE"]])
        assert all(t != "double" or n.endswith("_s") for b in "ABCE" for n, t in
                   saved._stitched(states).select(f"sums_{b}.*").dtypes)  # sums of odds only
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    want = training_features(history)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_scored_fixtures_do_not_move_with_their_features(spark):
    """Team states are sent to the fixtures even where Spark by itself would shuffle both; same rows either way."""
    from touchline.plans import features as fe
    rows = [(i, datetime.date(2020, 9, 1) + datetime.timedelta(days=i // 3), f"T{i % 7}", f"T{(i * 3 + 1) % 7 + 7}", "HDA"[i % 3]) for i in range(60)]
    m = spark.createDataFrame(rows, "match_id long, match_date date, home_team string, away_team string, ftr string")
    zero = [F.lit(1).cast("long").alias(c) for c in MATCH_COLUMNS if c not in (*m.columns, "htr", "season_year")]
    m = m.select("*", F.col("ftr").alias("htr"), F.lit(2020).alias("season_year"), *zero)
    pairs = m.select("home_team", "away_team").distinct()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = fe.fixture_features(m, pairs)
        a = sorted(got.collect())
        plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        fe.SENT_TEAMS, limit = 0, fe.SENT_TEAMS
        try:
            b = sorted(fe.fixture_features(m, pairs).collect())
        finally:
            fe.SENT_TEAMS = limit
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert a == b and len(a) == pairs.count()
    assert plan.count("BroadcastHashJoin") == 3
