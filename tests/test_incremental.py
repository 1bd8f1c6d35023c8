"""States merged day by day equal those of the whole history."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from touchline.plans import features as fe
from touchline.plans.incremental import RINGS, StateStore
from touchline.session import scratch_path
from touchline.sources import adapter


@pytest.fixture(scope="module")
def matches(spark):
    return adapter.landed_matches(spark, SF_SMALL)


def rows_of(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=str)


def test_merged_days_equal_a_rebuild(spark, matches):
    days = [r[0] for r in matches.select("match_date").distinct().orderBy(F.desc("match_date")).limit(4).collect()][::-1]
    store = StateStore.build(matches.where(F.col("match_date") < days[0]), scratch_path(spark, "store"), 16)
    late = matches.where(F.col("match_date") == days[1])
    for day in (days[0], days[2], days[3]):
        store.add(matches.where(F.col("match_date") == day))
    store.add(late)  # a day that comes late
    store.add(matches.where(F.col("match_date") == days[3]))  # and one that comes again
    whole = StateStore.build(matches, scratch_path(spark, "store"), 16)
    for name in [*RINGS, "totals"]:
        assert rows_of(store._read(name)) == rows_of(whole._read(name)), name
    got, want = store.saved(), fe.save_states(matches, scratch_path(spark, "states"))
    assert got.at == want.at == days[3] + dt.timedelta(days=1)
    assert sorted(got.teams.collect()) == sorted(want.teams.collect())
    fixtures = matches.select("home_team", "away_team").distinct().limit(60)
    a, b = (fe.fixture_features(None, fixtures, saved=s) for s in (got, want))
    assert rows_of(a) == rows_of(b)
    with pytest.raises(ValueError, match="up to"):
        store.saved(days[3])


def test_an_increment_reads_its_buckets_only(spark, matches):
    """No file of earlier matches, and of the store only the buckets of the day's keys."""
    store = StateStore.build(matches, scratch_path(spark, "store"), 64)
    path = scratch_path(spark, "day")
    one = matches.orderBy("match_date", "match_id").limit(1)
    one.withColumn("match_date", F.lit(dt.date(2031, 1, 1))).withColumn("match_id", F.lit(-1).cast("long")).write.parquet(path)
    day = spark.read.parquet(path)
    for name in [*RINGS, "totals"]:
        merged = store.merged(name, day)
        assert all(any(p.rsplit("/", 1)[1] in f for p in (store.path, path)) for f in merged.inputFiles())
        plan = merged._jdf.queryExecution().simpleString()
        scans = [line for line in plan.splitlines() if "FileScan" in line]
        pruned = ["bucket#" in s.split("PartitionFilters: [")[1].split("]")[0] for s in scans]
        assert pruned == ["/store-" in s for s in scans] and any(pruned)
        assert merged.select("bucket").distinct().count() <= 2
    before = {n: rows_of(store._read(n)) for n in RINGS}
    store.add(day)
    for n, (_, keys) in RINGS.items():
        now = rows_of(store._read(n))
        assert len(set(map(str, now)) - set(map(str, before[n]))) <= 2 and len(now) <= len(before[n]) + 2


def test_empty_increment(spark, matches):
    store = StateStore.build(matches, scratch_path(spark, "store"), 4)
    before = rows_of(store._read("A"))
    store.add(matches.limit(0))
    assert rows_of(store._read("A")) == before


def test_rings_of_other_keys_are_not_shuffled(spark, matches):
    """A merge moves the day's rings only; before, three exchanges moved the whole buckets."""
    store = StateStore.build(matches, scratch_path(spark, "store"), 4)
    day = matches.where(F.col("match_date") == matches.agg(F.max("match_date")).first()[0])
    for name in [*RINGS, "totals"]:
        old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        try:
            plan = store.merged(name, day)._jdf.queryExecution().executedPlan().toString()
        finally:
            for k, v in old.items():
                spark.conf.set(k, v)
        assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan, plan


def test_rings_without_a_key_are_merged_too(spark, matches):
    """A null key is a key like any other."""
    nameless = matches.withColumn("home_team", F.when(F.col("match_id") % 7 > 0, F.col("home_team")))
    last = matches.agg(F.max("match_date")).first()[0]
    store = StateStore.build(nameless.where(F.col("match_date") < last), scratch_path(spark, "store"), 4)
    store.add(nameless.where(F.col("match_date") == last))
    whole = StateStore.build(nameless, scratch_path(spark, "store"), 4)
    assert rows_of(store._read("B")) == rows_of(whole._read("B"))
