"""A deterministic ``matches`` table derived from the driver's orders + lineitem.

The test tables hold no football results, so every match query is run on this
view (FIXTURES.md F6).  It only supplies rows in the match schema; the jobs
take nothing from how it is made.  The same derivation is the SQL prefix of
every oracle query, so the rules below must stay in step with
``touchline.oracle.sql.ADAPTER_SQL``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.functions.columns import season_year
from touchline.session import scratch_path, session_key, shuffles_freed

_LANDED: dict = {}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def raw_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All derived matches, including those with no result (null ``ftr``)."""
    li = _read(spark, sf_dir, "lineitem")
    orders = _read(spark, sf_dir, "orders")
    q = F.col("l_quantity")
    per_order = li.groupBy(F.col("l_orderkey").alias("k")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(q).cast("bigint").alias("q"),
        F.sum(F.when(F.col("l_returnflag") == "R", q).otherwise(F.lit(0.0))).cast("bigint").alias("qr"),
        F.sum(F.when(F.col("l_linestatus") == "F", q).otherwise(F.lit(0.0))).cast("bigint").alias("qf"),
        F.sum(F.round(F.col("l_discount") * 100)).cast("bigint").alias("ds"),
        F.sum(F.round(F.col("l_tax") * 100)).cast("bigint").alias("tx"),
    )
    teams = 20 + _read(spark, sf_dir, "customer").count() // 150  # so teams grow with the data
    home = F.col("o_custkey") % teams
    g = orders.join(per_order, orders.o_orderkey == per_order.k, "left").select(
        F.col("o_orderkey").alias("match_id"),
        F.col("o_orderdate").cast("date").alias("match_date"),
        home.alias("home_no"),
        ((home + 1 + F.col("o_orderkey") % (teams - 1)) % teams).alias("away_no"),
        F.year("o_orderdate").alias("yr"),
        "n", "q", "qr", "qf", "ds", "tx",
        F.floor("o_totalprice").cast("bigint").alias("tp"),
        "o_custkey",
    )
    q, qr, qf, n, ds, tx = (F.col(c) for c in ("q", "qr", "qf", "n", "ds", "tx"))
    # goals are half chance, half the side's strength: history says something about the next match
    fthg, ftag = F.expr("(q % 5 + home_no * 7 % 5) div 2"), F.expr("(qr % 4 + away_no * 7 % 5) div 2")
    hthg, htag = F.least(fthg, n % 3), F.least(ftag, qf % 2)
    pre97 = F.col("yr") < 1997
    no_odds = F.col("match_id") % 10 < 3

    def result(a, b):
        return (F.when(q.isNull(), F.lit(None).cast("string"))
                .when(a > b, "H").when(a == b, "D").otherwise("A"))

    return g.select(
        "match_id", "match_date",
        F.concat(F.lit("T"), (F.lit(1000) + F.col("home_no")).cast("string")).alias("home_team"),
        F.concat(F.lit("T"), (F.lit(1000) + F.col("away_no")).cast("string")).alias("away_team"),
        fthg.alias("fthg"), ftag.alias("ftag"), result(fthg, ftag).alias("ftr"),
        hthg.alias("hthg"), htag.alias("htag"), result(hthg, htag).alias("htr"),
        (fthg + q % 7 + qr % 11).alias("hs"), (ftag + qr % 6 + qf % 11).alias("as_"),
        (fthg + q % 7).alias("hst"), (ftag + qr % 6).alias("ast"),
        F.when(pre97, None).otherwise(q % 3).alias("hhw"),
        F.when(pre97, None).otherwise(qr % 3).alias("ahw"),
        (q % 13).alias("hc"), (qf % 12).alias("ac"), (qr % 19).alias("hf"), (q % 18).alias("af"),
        F.when(pre97, None).otherwise(qf % 6).alias("ho"),
        F.when(pre97, None).otherwise(qr % 5).alias("ao"),
        (ds % 5).alias("hy"), (tx % 4).alias("ay"),
        F.when(ds % 23 == 0, 1).otherwise(0).alias("hr"),
        F.when(tx % 19 == 0, 1).otherwise(0).alias("ar"),
        F.when(no_odds, None).otherwise(F.lit(1.25) + (F.col("tp") % 16) * F.lit(0.25)).alias("b365h"),
        F.when(no_odds, None).otherwise(F.lit(2.5) + (F.col("o_custkey") % 8) * F.lit(0.25)).alias("b365d"),
        F.when(no_odds, None).otherwise(F.lit(1.25) + (F.col("match_id") % 24) * F.lit(0.25)).alias("b365a"),
    )


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean history (PF-1): rows with a date and a result, plus ``season_year``."""
    m = raw_matches(spark, sf_dir).dropna(subset=["match_date", "ftr"])
    return m.withColumn("season_year", season_year("match_date"))


def landed_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clean match table written once per session into the shared
    checkpoint folder and read back, as an ingest job would leave it.  Jobs
    then scan a pruned parquet table instead of re-deriving it per block."""
    key = (session_key(spark), sf_dir.rstrip("/"))
    path = _LANDED.get(key)
    if path is None:
        path = scratch_path(spark, "matches")
        # the production layout (partitioned by season, like land_seasons); a
        # hash-partitioned write lets AQE size the files, so later scans run in
        # parallel even when the source is a single small file
        with shuffles_freed(spark):
            (matches(spark, sf_dir).repartition("match_id").write.mode("overwrite")
             .partitionBy("season_year").parquet(path))
        _LANDED[key] = path
    return spark.read.parquet(path)
