"""``last_n_before_rows``: the state of each row's day, found without a state table."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from touchline.operators.asof import last_n_before_days, last_n_before_rows
from touchline.plans import features as fe
from touchline.sources import adapter
from tests.conftest import SF_SMALL


def _rows(spark, busy):
    """Keys with a row or two a day, one with nine on some days; rows without key or day; a row twice."""
    day = dt.date(2020, 1, 1)
    data = [(k, day + dt.timedelta(days=d), 100 * d + 10 * k + i, (7 * d + k + i) % 5, f"c{i}")
            for k in range(3) for d in range(12) for i in range(9 if k == 1 and d in busy else 1 + d % 2)]
    data += [(None, day, 9001, 1, "x"), (0, None, 9002, 2, "y"), data[5]]
    return spark.createDataFrame(data, "k int, match_date date, match_id long, v int, c string")


@pytest.mark.parametrize("busy, most", [((), 100), ((2, 3, 7), 100), ((2, 3, 7), 0)])
def test_rows_get_the_state_of_their_day(spark, busy, most):
    rows = _rows(spark, busy)
    aggs = {"n": F.count(F.lit(1)), "s": F.sum("v")}
    state = last_n_before_days(rows, ["k"], aggs, ["v"])
    values = [c for c in state.columns if c not in ("k", "match_date")]
    expected = rows.join(state, ["k", "match_date"], "left").select("match_id", "c", *values)
    got = last_n_before_rows(rows, ["k"], aggs, ["v"], carry=["c"], most=most)
    assert got.columns == expected.columns
    key = lambda r: tuple((v is None, v) for v in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, expected.collect()), key=key)


def test_training_features_move_rows_once_a_block(spark):
    """With no broadcast a block's wide rows move on the key and on the match id only."""
    history = adapter.landed_matches(spark, SF_SMALL)
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")
    old = [spark.conf.get(c) for c in names]
    for c, v in zip(names, ("-1", "false"), strict=True):
        spark.conf.set(c, v)
    try:
        plan = fe.training_features(history)._jdf.queryExecution().executedPlan().toString()
    finally:
        for c, v in zip(names, old, strict=True):
            spark.conf.set(c, v)
    # A, B, C: key and match id; E: totals, tails, their join, probe and match id
    assert plan.count("Exchange hashpartitioning") <= 16
    assert "REPARTITION_BY_COL" not in plan


@pytest.mark.parametrize("busy, most", [((), 100), ((2, 3, 7), 100), ((2, 3, 7), 0)])
def test_counted_days_give_the_same_state(spark, busy, most):
    rows = _rows(spark, busy)
    aggs = {"n": F.count(F.lit(1)), "s": F.sum("v")}
    want = last_n_before_days(rows, ["k"], aggs, ["v"])
    got = last_n_before_days(rows, ["k"], aggs, ["v"], counted=True, most=most)
    assert got.columns == want.columns
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.collect()), key=key)


def test_saved_states_rank_no_quiet_day_and_grow_in_buckets(spark, monkeypatch):
    """Rows of days with few matches move once to their key; large histories get more buckets
    and stitch partitions; days before which a key has no rows are not stored."""
    from touchline.plans import saved
    history = adapter.landed_matches(spark, SF_SMALL)
    quiet = history.dropDuplicates(["match_date"])
    plan = fe.raw_state(quiet, "A")._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan and "_rd" not in plan
    monkeypatch.setattr(fe, "STITCH_ROWS", history.count() // 70)
    states = saved.save_training_states(history)
    assert states.parts >= 70
    detail = spark.sql(f"DESCRIBE FORMATTED {states.states['B']}").where("col_name = 'Num Buckets'").first()
    assert int(detail["data_type"]) >= 70
    assert spark.table(states.states["A"]).where("n = 0").isEmpty()
    got, want = saved.training_features(states), fe.training_features(history)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
