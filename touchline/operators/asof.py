"""Strict as-of "last N before this day" and season-to-date state.

Requirement (JN-3, W-1..W-6): for a row of key K on day d, use the N latest
history rows of K whose date is strictly before d (ties broken by id), so
same-day rows never see each other.

Plan, chosen for skew: one key may hold a third of all rows, so no step may
put all rows of a key into one task.

1. ``tails``: per (K, day) keep the day's N last rows.  This is a grouped
   top-k (``row_number() <= N``); Spark plans it as a partial
   ``WindowGroupLimit`` before the shuffle on (K, day), so a hot key is spread
   over its days and at most N rows per (K, day, map task) move.
2. A ROWS frame of N rows over the tails, partitioned by K.  A key now holds
   at most N rows per day it played, which is bounded by the calendar, not by
   the data volume.
3. The state at the first tail row of a day (frame -N..-1) is the state
   strictly before that day; the state at the last row (frame -(N-1)..0) is
   the state at the end of the day, used for as-of lookups of arbitrary probe
   dates (fixtures).

No inequality join, no exploded copies, no ``collect_list``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions.cache import per_context
from touchline.schema import LAST_N
from touchline.session import scratch_path


@per_context
def _frame_cols(aggs_id: int, aggs_ref: tuple, keys: tuple, lag_cols: tuple, n: int, date_col: str,
                id_col: str, through: bool) -> list:
    """Window columns of the last-N operators, built once per context.
    ``aggs_ref`` keeps the aggregate mapping alive so its id stays unique."""
    aggs = aggs_ref[0]
    w = Window.partitionBy(*keys).orderBy(date_col, id_col)
    if through:
        frame = w.rowsBetween(-(n - 1), 0)
        cols = [*keys, date_col, F.lead(date_col, 1).over(w).alias("_next_day")]
    else:
        frame = w.rowsBetween(-n, -1)
        cols = [*keys, date_col, F.lag(date_col, 1).over(w).alias("_prev_day")]
    cols += [agg.over(frame).alias(name) for name, agg in aggs.items()]
    for c in lag_cols:
        if through:
            cols.append(F.col(c).alias(f"{c}__1"))
            cols += [F.lag(c, i - 1).over(w).alias(f"{c}__{i}") for i in range(2, n + 1)]
        else:
            cols += [F.lag(c, i).over(w).alias(f"{c}__{i}") for i in range(1, n + 1)]
    return cols


class _Ref(tuple):
    """A tuple holding one object, hashed and compared by that object's id."""

    def __hash__(self):
        return id(self[0])

    def __eq__(self, other):
        return isinstance(other, _Ref) and self[0] is other[0]


def _tails(history: DataFrame, keys: Sequence[str], date_col: str, id_col: str, n: int) -> DataFrame:
    w = Window.partitionBy(*keys, date_col).orderBy(F.col(id_col).desc())
    return history.withColumn("_rd", F.row_number().over(w)).where(F.col("_rd") <= n).drop("_rd")


def _busy_days(rows: DataFrame, days: Sequence[str], n: int) -> tuple[DataFrame, int]:
    """The days on which a key has more than ``n`` rows, counted in narrow form and written; their number."""
    path = scratch_path(rows.sparkSession, "busy-days")
    rows.groupBy(*days).agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") > n).select(*days).write.parquet(path)
    busy_days = rows.sparkSession.read.parquet(path)
    return busy_days, busy_days.count()


def _on_days(busy_days: DataFrame, days: Sequence[str]) -> tuple[DataFrame, Column]:
    """The busy days as the small side of a join, and its condition."""
    few = F.broadcast(busy_days.select(*[F.col(c).alias(f"_b_{c}") for c in days]))
    return few, reduce(and_, [F.col(c).eqNullSafe(F.col(f"_b_{c}")) for c in days])


def _counted_tails(history: DataFrame, keys: Sequence[str], date_col: str, id_col: str, n: int, most: int) -> DataFrame:
    """The rows of :func:`_tails`, where only those of busy days are ranked: all
    others are tails as they are, so they are neither sorted nor moved for it.
    More than ``most`` busy days: all rows are ranked."""
    days = [*keys, date_col]
    busy_days, busy = _busy_days(history, days, n)
    if busy > most:
        return _tails(history, keys, date_col, id_col, n)
    if not busy:
        return history
    few, same = _on_days(busy_days, days)
    ranked = _tails(history.join(few, same, "left_semi"), keys, date_col, id_col, n)
    return history.join(few, same, "left_anti").unionByName(ranked)


def last_n_before_days(history: DataFrame, keys: Sequence[str], aggs: Mapping[str, Column],
                       lag_cols: Sequence[str] = (), n: int = LAST_N,
                       date_col: str = "match_date", id_col: str = "match_id", counted: bool = False,
                       most: int = 100_000) -> DataFrame:
    """One row per (keys, day) present in ``history``: ``aggs`` over the ``n``
    latest rows of the key strictly before that day, plus ``{c}__{i}`` = value
    of ``c`` in the i-th latest of those rows (i = 1 is the newest).

    ``counted``: a job first counts the days on which a key has more than ``n``
    rows, and only the rows of these are ranked (unless there are over ``most``)."""
    tails = _counted_tails(history, keys, date_col, id_col, n, most) if counted else _tails(history, keys, date_col, id_col, n)
    cols = _frame_cols(id(aggs), _Ref((aggs,)), tuple(keys), tuple(lag_cols), n, date_col, id_col, False)
    first_of_day = F.col("_prev_day").isNull() | (F.col("_prev_day") != F.col(date_col))
    return tails.select(*cols).where(first_of_day).drop("_prev_day")


def last_n_before_rows(history: DataFrame, keys: Sequence[str], aggs: Mapping[str, Column],
                       lag_cols: Sequence[str] = (), carry: Sequence[str] = (), n: int = LAST_N,
                       date_col: str = "match_date", id_col: str = "match_id", most: int = 100_000) -> DataFrame:
    """The state of :func:`last_n_before_days` at each row of ``history``: ``id_col``,
    ``carry`` and the state (null where a key or the day is null).

    Days on which a key has more than ``n`` rows are counted first, in narrow form.
    All other rows are tails as they are and get their state in the window itself,
    so they move once and meet no state table.  Rows of the counted days are ranked,
    and those that are no tails are joined to their day's state.  More than ``most``
    such days: every row is joined to its day's state."""
    days, own = [*keys, date_col], [id_col, *carry]
    values = [*aggs, *[f"{c}__{i}" for c in lag_cols for i in range(1, n + 1)]]
    known = reduce(and_, [F.col(c).isNotNull() for c in keys])
    placed = history.where(known)  # undated rows come before all days, as in last_n_before_days
    busy_days, busy = _busy_days(placed, days, n)
    if busy > most:
        state = last_n_before_days(history, keys, aggs, lag_cols, n, date_col, id_col)
        return history.select(*own, *days).join(state, days, "left").select(*own, *values)
    tails = placed
    if busy:
        few, same = _on_days(busy_days, days)
        rank = F.row_number().over(Window.partitionBy(*days).orderBy(F.col(id_col).desc()))
        ranked = placed.join(few, same, "left_semi").withColumn("_rd", rank)
        tails = placed.join(few, same, "left_anti").unionByName(ranked.where(F.col("_rd") <= n).drop("_rd"))
    cols = _frame_cols(id(aggs), _Ref((aggs,)), tuple(keys), tuple(lag_cols), n, date_col, id_col, False)
    first = F.first(F.struct(*values)).over(Window.partitionBy(*days).orderBy(id_col))  # of the day, for all its rows
    out = tails.select(*own, *cols).select(*own, F.when(F.col(date_col).isNotNull(), first).alias("_s")).select(*own, "_s.*")
    if busy:
        of_keys = placed.join(F.broadcast(busy_days.select(*keys).distinct()), list(keys), "left_semi")
        state = last_n_before_days(of_keys, keys, aggs, lag_cols, n, date_col, id_col).join(few, same, "left_semi")
        rest = ranked.where(F.col("_rd") > n).select(*own, *days)
        out = out.unionByName(rest.join(state, days, "left").select(*own, *values))
    kinds = dict(out.dtypes)
    nowhere = history.where(~known).select(*own, *[F.lit(None).cast(kinds[c]).alias(c) for c in values])
    return out.unionByName(nowhere)


def last_n_through_days(history: DataFrame, keys: Sequence[str], aggs: Mapping[str, Column],
                        lag_cols: Sequence[str] = (), n: int = LAST_N,
                        date_col: str = "match_date", id_col: str = "match_id") -> DataFrame:
    """Like :func:`last_n_before_days` but the state at the end of each day
    (the day's own rows included).  Feed it to :func:`asof_before`."""
    tails = _tails(history, keys, date_col, id_col, n)
    cols = _frame_cols(id(aggs), _Ref((aggs,)), tuple(keys), tuple(lag_cols), n, date_col, id_col, True)
    last_of_day = F.col("_next_day").isNull() | (F.col("_next_day") != F.col(date_col))
    return tails.select(*cols).where(last_of_day).drop("_next_day")


def totals_by_day(rows: DataFrame, keys: Sequence[str], sums: Mapping[str, Column],
                  date_col: str = "match_date", include_day: bool = False) -> DataFrame:
    """Running totals per (keys, day) over all earlier days of the key
    (``include_day`` adds the day itself).  Rows are first summed per day with
    a map-side partial aggregate, so the window only sees one row per day."""
    day = rows.groupBy(*keys, date_col).agg(*[agg.alias(name) for name, agg in sums.items()])
    end = 0 if include_day else -1
    w = Window.partitionBy(*keys).orderBy(date_col).rowsBetween(Window.unboundedPreceding, end)
    return day.select(*keys, date_col, *[F.sum(name).over(w).alias(name) for name in sums])


def asof_before(state: DataFrame, probes: DataFrame, keys: Sequence[str],
                value_cols: Sequence[str], date_col: str = "match_date") -> DataFrame:
    """For each distinct probe (keys, date): the latest ``state`` row of the key
    dated strictly before the probe date (all values null when none).

    Probes are unioned into the per-day state table (one row per key-day, so
    bounded by the calendar) and sorted before same-day state rows; the value
    is ``last(..., ignorenulls)`` over the rows before the probe.
    """
    st = state.select(*keys, date_col, F.lit(1).alias("_h"), F.struct(*value_cols).alias("_s"))
    stype = st.schema["_s"].dataType
    pr = (probes.select(*keys, date_col).distinct()
          .select(*keys, date_col, F.lit(0).alias("_h"), F.lit(None).cast(stype).alias("_s")))
    w = Window.partitionBy(*keys).orderBy(date_col, "_h").rowsBetween(Window.unboundedPreceding, -1)
    out = (st.unionByName(pr)
           .select(*keys, date_col, "_h", F.last("_s", ignorenulls=True).over(w).alias("_v"))
           .where(F.col("_h") == 0))
    return out.select(*keys, date_col, *[F.col("_v")[c].alias(c) for c in value_cols])


def last_n_at(history: DataFrame, keys: Sequence[str], aggs: Mapping[str, Column], as_of,
              lag_cols: Sequence[str] = (), n: int = LAST_N,
              date_col: str = "match_date", id_col: str = "match_id") -> DataFrame:
    """One row per key: ``aggs`` over the key's ``n`` latest rows dated
    strictly before the single date ``as_of``, and ``{c}__{i}`` for the i-th
    latest.  Same output columns as :func:`last_n_before_days` (with
    ``date_col`` = ``as_of``), for scoring fixtures that share one date: a
    filtered scan, a per-key top-n (partial ``WindowGroupLimit`` before the
    shuffle) and one ``groupBy``."""
    day = F.lit(as_of).cast("date")
    w = Window.partitionBy(*keys).orderBy(F.col(date_col).desc(), F.col(id_col).desc())
    top = (history.where(F.col(date_col) < day)
           .withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n))
    cols = [agg.alias(name) for name, agg in aggs.items()]
    cols += [F.max(F.when(F.col("_r") == i, F.col(c))).alias(f"{c}__{i}") for c in lag_cols
             for i in range(1, n + 1)]
    return top.groupBy(*keys).agg(*cols).withColumn(date_col, day)


def totals_at(rows: DataFrame, keys: Sequence[str], sums: Mapping[str, Column], as_of,
              date_col: str = "match_date") -> DataFrame:
    """Totals per key over all rows dated strictly before ``as_of``."""
    day = F.lit(as_of).cast("date")
    return (rows.where(F.col(date_col) < day).groupBy(*keys)
            .agg(*[agg.alias(name) for name, agg in sums.items()]).withColumn(date_col, day))
