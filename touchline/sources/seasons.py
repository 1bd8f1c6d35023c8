"""Season CSV files -> canonical match table (SRC-1..8), season refresh (SNK-1).

Season files are ragged: columns differ between seasons and appear in any
order.  One job finds the header of each file; then all files are read in one
text scan, whatever the number of headers: each line meets the header of its
file (a small table of the places of the canonical columns), is split once by
``from_csv`` and its fields are picked by place, so a missing column is a typed
null.  A multi-file CSV read would map columns by position and shift them.

Rows with more fields than the header are skipped, shorter rows are kept with
a null tail (the pandas ``on_bad_lines='skip'`` rule); fields are counted
outside quotes.  Header lines have no date and fall with all other rows
without one.

``match_id`` hashes the parsed row and numbers rows that repeat, so it is the
same whatever file, folder or header a row comes with, and no two rows share it.
"""

from __future__ import annotations

import csv
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.functions.columns import parse_match_date, season_year
from touchline.schema import MATCH_COLUMNS, OUTCOME_LABELS, RAW_COLUMNS, SEASON_START_MONTH
from touchline.session import scratch_path

LATIN1 = "ISO-8859-1"


def headers(spark: SparkSession, source: str, pattern: str = "*.csv") -> dict[tuple, list[str]]:
    """Header -> files of the CSV files under ``source``, found by one job
    whatever the number of files: the first line of each file's first block.
    Zero-byte files (a failed download) have none and are left out; a file
    whose first line has no ``Date`` raises, as its rows could not be read."""
    lines = (spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").text(source)
             .select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"),
                     F.monotonically_increasing_id().alias("line_no")).where("at = 0"))
    first = lines.groupBy("path").agg(F.min_by("value", "line_no").alias("line"))
    found: dict[tuple, list[str]] = defaultdict(list)
    for r in sorted(first.collect()):  # file names, which any file scan keeps on the driver too
        names = tuple(next(csv.reader([r["line"].lstrip("\ufeff").rstrip("\r")]), []))
        if "Date" not in names:
            raise ValueError(f"no Date column in the header of {r['path']}: {r['line'][:200]!r}")
        found[names].append(r["path"])
    return dict(found)


def _field_count(text: F.Column) -> F.Column:
    """Fields of a raw CSV line: commas outside double-quoted runs, plus one."""
    bare = F.regexp_replace(text, '"[^"]*"', "")
    return F.size(F.split(bare, ",", -1))


def _number(v: F.Column) -> F.Column:
    """Text -> double; unparsable text and NaN become null (SC-12)."""
    d = v.try_cast("double")
    return F.when(F.isnan(d), F.lit(None).cast("double")).otherwise(d)


def _canonical(field) -> list[F.Column]:
    """Canonical columns; ``field(raw name)`` is the text of a raw column."""
    cols = []
    for raw_name, (name, typ) in RAW_COLUMNS.items():
        v = field(raw_name)
        if name == "match_date":
            cols.append(parse_match_date(v).alias(name))
        elif isinstance(typ, T.IntegerType):
            cols.append(_number(v).try_cast("int").alias(name))
        elif isinstance(typ, T.DoubleType):
            cols.append(_number(v).alias(name))
        else:
            cols.append(v.alias(name))
    return cols


def read_lines(spark: SparkSession, source: str, found: dict[tuple, list[str]], encoding: str = LATIN1,
               strict: bool = False) -> DataFrame:
    """The rows of all files under their headers (``found``) in one scan.

    ``strict=False`` skips over-long rows (SRC-3); ``strict=True`` fails the
    job on the first one (SRC-4).
    """
    names = list(RAW_COLUMNS)
    places = [(path, len(header), [header.index(n) if n in header else None for n in names])
              for header, paths in sorted(found.items()) for path in paths]  # a row per file
    heads = spark.createDataFrame(places, "head_path string, width int, place array<int>")
    lines = (spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").text(source)
             .select("value", F.col("_metadata.file_path").alias("path")))
    # the text source keeps a line's bytes as they are
    text = F.col("value") if encoding.upper().replace("-", "") == "UTF8" else F.decode(F.col("value").cast("binary"), encoding)
    met = lines.join(heads, F.col("path") == F.col("head_path")).select(text.alias("line"), "width", "place")
    most = max(len(h) for h in found)
    long_row = _field_count(F.col("line")) > F.col("width")
    if strict:
        met = met.where(F.when(long_row, F.raise_error(F.concat(F.lit("too many fields: "), F.col("line")))).otherwise(F.lit(True)))
    else:
        met = met.where(~long_row)
    fields = F.from_csv("line", ", ".join(f"c{i} string" for i in range(most)), {"mode": "PERMISSIVE"})
    # a generator: filters on the fields are not pushed below it, where each would parse the line again
    split = met.select(F.inline(F.array(fields)), "place").select(F.array(*[f"c{i}" for i in range(most)]).alias("field"), "place")
    return split.select(*_canonical(lambda raw: F.get(F.col("field"), F.get(F.col("place"), names.index(raw)))))


def with_match_id(rows: DataFrame) -> DataFrame:
    """Adds ``match_id``: a hash of the whole row; rows that share it (repeats,
    or a chance collision) are numbered and hashed again with their number.
    Repeats are counted before any of them meet, so a line that is repeated
    without end is one row until its copies get their numbers."""
    cols = [F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in rows.columns]
    once = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_n")) \
        .withColumn("_h", F.xxhash64(*cols)).withColumn("_tie", F.xxhash64(F.lit(1), *cols))
    before = Window.partitionBy("_h").orderBy("_tie").rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum("_n").over(before), F.lit(0))  # more than one row only after a collision
    block = F.explode(F.expr("sequence(0L, (_n - 1) div 65536)"))
    nth = F.explode(F.expr("sequence(_b * 65536 + 1, least(_n, (_b + 1) * 65536))"))
    each = once.withColumn("_f", first).withColumn("_b", block).withColumn("_i", nth)
    number = F.col("_f") + F.col("_i")
    return each.withColumn("match_id", F.when(number == 1, F.col("_h")).otherwise(F.xxhash64("_h", number.cast("int")))) \
        .select(*rows.columns, "match_id")


def read_seasons(spark: SparkSession, source: str, encoding: str = LATIN1, strict: bool = False,
                 start_month: int = SEASON_START_MONTH) -> DataFrame:
    """All season files under ``source``: one scan under the files' headers,
    rows without date or result dropped (PF-1), ``season_year`` added.  Rows
    whose result is not H, D or A raise: they could not be labelled."""
    found = headers(spark, source)
    if not found:
        raise FileNotFoundError(f"no CSV files under {source}")
    df = known_results(read_lines(spark, source, found, encoding, strict).dropna(subset=["match_date", "ftr"]))
    return with_match_id(df).withColumn("season_year", season_year("match_date", start_month)).select(*MATCH_COLUMNS)


def known_results(df: DataFrame) -> DataFrame:
    """Fails the job on the first row whose result letter is not H, D or A."""
    bad = ~F.col("ftr").isin(*OUTCOME_LABELS)
    return df.withColumn("ftr", F.when(bad, F.raise_error(F.concat(F.lit("unknown result: "), F.col("ftr"))))
                         .otherwise(F.col("ftr")))


def land_seasons(spark: SparkSession, source: str, table_path: str, encoding: str = LATIN1) -> DataFrame:
    """UQ-1 as an ingest step: parse every season file and write the canonical
    match table partitioned by ``season_year`` (overwriting ``table_path``)."""
    df = read_seasons(spark, source, encoding)
    df.write.mode("overwrite").partitionBy("season_year").parquet(table_path)
    return spark.read.parquet(table_path).select(*MATCH_COLUMNS)


def load_seasons(spark: SparkSession, source: str, encoding: str = LATIN1) -> DataFrame:
    """Parse the season files into a table in the shared scratch folder and
    return it (lineage ends at the written table)."""
    return land_seasons(spark, source, scratch_path(spark, "seasons"), encoding)


def refresh_season(spark: SparkSession, landed: str, table_path: str, season: int, encoding: str = "UTF-8",
                   strict: bool = True) -> DataFrame:
    """SNK-1: replace season ``season`` by a freshly landed file and keep all
    other season partitions.  The file is read like the current-season file:
    default encoding, errors raised (SRC-4).  A file with rows of another
    season, or with none, raises before anything is written: overwriting a
    season with a few stray rows would destroy it."""
    df = read_seasons(spark, landed, encoding, strict=strict)
    path = scratch_path(spark, "refresh")
    df.write.parquet(path)  # parsed once, so that what is checked is what is written
    df = spark.read.parquet(path)
    seen = {r["season_year"]: r["n"] for r in df.groupBy("season_year").agg(F.count(F.lit(1)).alias("n")).collect()}
    if set(seen) != {season}:
        raise ValueError(f"season {season} expected, the landed file has rows of {dict(sorted(seen.items()))}")
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("season_year").parquet(table_path))
    return spark.read.parquet(table_path).select(*MATCH_COLUMNS)


def write_season_csv(df: DataFrame, path: str, columns: list[tuple[str, F.Column]],
                     encoding: str = LATIN1, by_season: bool = True) -> None:
    """Write matches as season CSV files with the given (header, value) columns,
    one folder per season.  Used to land data in the raw layout."""
    out = df.select(*[c.alias(h) for h, c in columns], *(["season_year"] if by_season else []))
    w = out.write.mode("overwrite").option("header", True).option("encoding", encoding)
    (w.partitionBy("season_year") if by_season else w).csv(path)
