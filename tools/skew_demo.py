"""Show that the as-of operator's window partitions stay bounded under a hot key.

    python tools/skew_demo.py [sf_dir]

Makes one team the home side of a third of all matches (a demo input, not a
registered query) and compares, for block B, the largest window partition a
plain per-key window would hold (all rows of the key) with the largest
partition of the frame window over the day tails (at most 5 rows per day).
"""

from __future__ import annotations

import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    from pyspark.sql import functions as F
    from touchline.operators.asof import _tails
    from touchline.plans import features as fe
    from touchline.session import get_session
    from touchline.sources import adapter
    spark = get_session("local[8]", shuffle_partitions=16)
    m = adapter.landed_matches(spark, sf_dir)
    hot = m.withColumn("home_team", F.when(F.col("match_id") % 3 == 0, F.lit("HOT")).otherwise(F.col("home_team")))
    rows = hot.count()
    raw_max = hot.groupBy("home_team").count().agg(F.max("count")).first()[0]
    tails = _tails(hot.select("home_team", "match_date", "match_id"), ["home_team"], "match_date", "match_id", 5)
    tail_max = tails.groupBy("home_team").count().agg(F.max("count")).first()[0]
    days = hot.where(F.col("home_team") == "HOT").select("match_date").distinct().count()
    t0 = time.perf_counter()
    fe.block_query(hot, "B").write.format("noop").mode("overwrite").save()
    t1 = time.perf_counter()
    print(f"rows {rows}; hot key rows {raw_max} ({raw_max / rows:.0%}); hot key days {days}; "
          f"largest frame-window partition {tail_max} rows (<= 5 x days); block B {t1 - t0:.1f}s")


if __name__ == "__main__":
    main()
