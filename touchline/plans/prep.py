"""Model input preparation: split (ML-1), folds (ML-9), class weights (ML-4),
standardisation (ML-2).  All deterministic and independent of partitioning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.operators.prefix import positions

_M31 = 2147483648
#: Odd multipliers below 2^31 and shifts of the mixing rounds.
_ROUNDS = ((1103515245, 15), (1540483477, 13), (1664525061, 16))


def seed_word(seed: int) -> int:
    """The seed spread over 31 bits."""
    return (seed * 2654435769 + 12345) % _M31


def portable_hash(id_col="match_id", seed: int = 42) -> Column:
    """A 31-bit hash of a 64-bit integer id and a seed, written with plain
    integer arithmetic so any SQL engine computes the same value (no overflow:
    all factors are below 2^31).  Each round multiplies and folds the high
    bits back by xor, so every bit of the seed reaches every bit of the result."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    low = F.pmod(c, F.lit(_M31))
    high = F.pmod(((c - low) / F.lit(_M31)).cast("long"), F.lit(_M31))
    h = low.bitwiseXOR(F.pmod(high * 1540483477, F.lit(_M31))).bitwiseXOR(F.lit(seed_word(seed)))
    for mult, shift in _ROUNDS:
        h = F.pmod(h * F.lit(mult), F.lit(_M31))
        h = h.bitwiseXOR(F.shiftright(h, shift))
    return h


def hash_percent(id_col="match_id", seed: int = 42) -> Column:
    """0..99 from the high bits of :func:`portable_hash`."""
    return F.pmod(F.floor(portable_hash(id_col, seed) / F.lit(65536)), F.lit(100))


def train_test_split(df: DataFrame, test_pct: int = 20, seed: int = 42, id_col: str = "match_id") -> DataFrame:
    """ML-1: adds ``split`` = 'train' | 'test', about test_pct % test.  Random
    but keyed on the row id, so stable under repartitioning and recomputation
    (``randomSplit`` is not)."""
    return df.withColumn("split", F.when(hash_percent(id_col, seed) < 100 - test_pct, "train").otherwise("test"))


def time_split(df: DataFrame, cutoff_date, date_col: str = "match_date") -> DataFrame:
    """D5 option: rows before ``cutoff_date`` train, the rest test."""
    return df.withColumn("split", F.when(F.col(date_col) < F.lit(cutoff_date).cast("date"), "train")
                         .otherwise("test"))


def rolling_folds(df: DataFrame, k: int = 5, embargo_days: int = 7, date_col: str = "match_date",
                  id_col: str = "match_id") -> DataFrame:
    """D5 option for CV: ``fold, <id>, part`` with part 'train', 'embargo' or
    'test', so that a fold trains on what was played before its test rows.

    The days are cut, in order, into k + 1 blocks of about equal numbers of
    rows (a day is never cut).  Fold f tests on block f + 1 and trains on all
    earlier blocks but the last ``embargo_days`` days before it.  Rows are
    counted by day first; the running count is over days, one row each."""
    day = df.groupBy(date_col).agg(F.count(F.lit(1)).alias("_n"))
    order = Window.orderBy(date_col)  # a row per day: bounded by the calendar
    every = Window.partitionBy()
    before = F.coalesce(F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    block = F.floor(before * F.lit(k + 1) / F.sum("_n").over(every)).cast("int")
    days = day.select(date_col, block.alias("_block"))
    starts = days.groupBy("_block").agg(F.min(date_col).alias("_first")).where("_block > 0") \
        .select((F.col("_block") - 1).alias("fold"), F.col("_first"))  # k rows
    asked = F.explode(F.sequence(F.greatest(F.col("_block") - 1, F.lit(0)), F.lit(k - 1)))  # folds whose test is not earlier
    parts = days.withColumn("fold", asked).join(F.broadcast(starts), "fold").select(
        F.col(date_col).alias("_day"), "fold",
        F.when(F.col("_block") == F.col("fold") + 1, "test")
        .when(F.datediff("_first", date_col) <= embargo_days, "embargo").otherwise("train").alias("part"))
    return df.join(parts, F.col(date_col) == F.col("_day")).select("fold", id_col, "part")


def stratified_folds(df: DataFrame, k: int = 5, label: str = "outcome", id_col: str = "match_id",
                     bucket_rows: int = 4096, seed: int = 42) -> DataFrame:
    """ML-9: ``fold`` in 0..k-1, dealt round-robin within each class in a
    fixed pseudo-random order (hash, id), so every fold holds each class in
    the same proportion (sizes differ by at most one).  The within-class
    position is computed with bucketed running counts, not one window per
    class; the number of buckets follows the number of rows."""
    buckets = max(1, -(-df.count() // bucket_rows))
    h = portable_hash(id_col, seed)
    bucket = F.floor(h * F.lit(buckets) / F.lit(_M31)).cast("long")
    ranked = positions(df, [label], bucket, [h, F.col(id_col)], name="_pos")
    return ranked.withColumn("fold", F.pmod(F.col("_pos"), F.lit(k)).cast("int")).drop("_pos")


def class_weights(df: DataFrame, label: str = "outcome") -> DataFrame:
    """ML-4 'balanced': weight_c = n / (classes * n_c).  One row per class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_class"))
    every = Window.partitionBy()  # a handful of rows: one per class
    return counts.select(label, "n_class",
                         (F.sum("n_class").over(every).cast("double")
                          / (F.count(F.lit(1)).over(every) * F.col("n_class")).cast("double")).alias("weight"))


def with_weights(df: DataFrame, label: str = "outcome") -> DataFrame:
    """Attach the class weight of each row (small class table, broadcast)."""
    return df.join(F.broadcast(class_weights(df, label).select(label, "weight")), label, "left")


def standardise_stats(train: DataFrame, features: list[str], side: int = 12) -> DataFrame:
    """ML-2: mean and population standard deviation per feature on the
    training rows; one row per feature.  ``side`` features at a time are
    aggregated and unpivoted: Spark compiles an aggregate only while its
    columns, five per feature, are fewer than ``spark.sql.codegen.maxFields``."""
    def some(first: int) -> DataFrame:
        own = list(enumerate(features[first:first + side], first))
        aggs = []
        for i, c in own:
            aggs += [F.avg(c).alias(f"m{i}"), F.stddev_pop(c).alias(f"s{i}")]
        rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(i).alias("ord"),
                                  F.col(f"m{i}").alias("mean"),
                                  F.col(f"s{i}").alias("std"))
                         for i, c in own])
        return train.agg(*aggs).select(F.inline(rows))

    return reduce(DataFrame.unionByName, [some(first) for first in range(0, len(features), side)])


def standardise(df: DataFrame, features: list[str], train: DataFrame | None = None) -> DataFrame:
    """(x - mean) / std with training statistics; a zero deviation scales by 1
    (as the reference scaler does).  The statistics are two numbers per
    feature (one aggregate job); they enter the plan as literals."""
    src = train if train is not None else df
    aggs = []
    for i, c in enumerate(features):
        aggs += [F.avg(c).alias(f"_m{i}"), F.stddev_pop(c).alias(f"_s{i}")]
    stats = src.agg(*aggs).first()
    cols = []
    for i, c in enumerate(features):
        mean, sd = stats[f"_m{i}"] or 0.0, stats[f"_s{i}"] or 0.0
        cols.append(((F.col(c) - F.lit(mean)) / F.lit(sd if sd != 0 else 1.0)).alias(c))
    keep = [c for c in df.columns if c not in features]
    return df.select(*keep, *cols)
