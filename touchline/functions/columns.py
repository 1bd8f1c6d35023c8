"""Column expressions shared by every job.  All are built-in Spark functions,
so they stay inside whole-stage codegen; none is a Python UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from touchline.schema import LABEL_TEXT, OUTCOME_LABELS, OUTCOME_TEXT, SEASON_START_MONTH


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def f64(x) -> Column:
    return _c(x).cast("double")


def nz(x) -> Column:
    """Null-skipping sums give 0 on an empty/all-null set."""
    return F.coalesce(_c(x), F.lit(0))


def ratio(num, den) -> Column:
    """a / b when b > 0, else 0 (ANSI division by zero never happens)."""
    den = _c(den)
    return F.when(den > 0, f64(num) / f64(den)).otherwise(F.lit(0.0))


def inv_mean(total, count) -> Column:
    """1 / mean of the non-null odds; 0 when there are none or the mean is 0.

    It inverts the mean, not the mean of inverses.  ``total``/``count`` are the
    sum and non-null count of the odds column over the window.
    """
    total, count = _c(total), _c(count)
    mean = f64(total) / f64(count)
    return F.when((count > 0) & (total != 0), F.lit(1.0) / mean).otherwise(F.lit(0.0))


def pair_lo(home="home_team", away="away_team") -> Column:
    return F.least(_c(home), _c(away))


def pair_hi(home="home_team", away="away_team") -> Column:
    return F.greatest(_c(home), _c(away))


def season_year(date_col="match_date", start_month: int = SEASON_START_MONTH) -> Column:
    """Season of a date: its year if month >= start_month, else the year before."""
    return F.year(F.add_months(_c(date_col), -(start_month - 1)))


def parse_match_date(text) -> Column:
    """Day-first date text in ``d/m/yy`` or ``d/m/yyyy``; the first format that
    parses wins, anything else is null.

    Two-digit years pivot like C ``strptime``: 69-99 -> 19xx, 00-68 -> 20xx.
    Spark's ``yy`` always gives 20xx, so years >= 2069 move back a century.
    """
    t = F.trim(_c(text))
    short = F.try_to_timestamp(t, F.lit("d/M/yy")).cast("date")
    short = F.when(F.year(short) >= 2069, F.add_months(short, -1200)).otherwise(short)
    long_ = F.try_to_timestamp(t, F.lit("d/M/yyyy")).cast("date")
    return F.coalesce(short, long_)


def outcome_label(ftr="ftr") -> Column:
    """H/D/A -> 0/1/2; anything else is null (rows are rejected by the caller)."""
    c = _c(ftr)
    e = F.lit(None).cast("int")
    for k, v in OUTCOME_LABELS.items():
        e = F.when(c == k, F.lit(v)).otherwise(e)
    return e


def label_text(label) -> Column:
    c = _c(label)
    e = F.lit(None).cast("string")
    for k, v in LABEL_TEXT.items():
        e = F.when(c == k, F.lit(v)).otherwise(e)
    return e


def outcome_text(ftr="ftr") -> Column:
    c = _c(ftr)
    e = F.lit(None).cast("string")
    for k, v in OUTCOME_TEXT.items():
        e = F.when(c == k, F.lit(v)).otherwise(e)
    return e


def pct_text(p) -> Column:
    """Python's ``format(p, '.1%')``: one decimal, percent sign."""
    return F.format_string("%.1f%%", f64(p) * F.lit(100.0))
