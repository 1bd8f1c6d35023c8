"""Team ledger: two rows per match, one per side (PF-6, W-4, W-5)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def team_ledger(matches: DataFrame) -> DataFrame:
    """(match_id, match_date, season_year, team, opponent, venue, gf, ga, pts, win).

    Built with ``inline(array(home_side, away_side))`` so the input is scanned
    once and no shuffle is needed.
    """
    ftr = F.col("ftr")

    def side(team, opp, venue, gf, ga, win_letter):
        return F.struct(
            F.col(team).alias("team"), F.col(opp).alias("opponent"), F.lit(venue).alias("venue"),
            F.col(gf).alias("gf"), F.col(ga).alias("ga"),
            F.when(ftr == win_letter, 3).when(ftr == "D", 1).otherwise(0).alias("pts"),
            F.when(ftr == win_letter, 1).otherwise(0).alias("win"),
        )

    sides = F.array(side("home_team", "away_team", "H", "fthg", "ftag", "H"),
                    side("away_team", "home_team", "A", "ftag", "fthg", "A"))
    return matches.select("match_id", "match_date", "season_year", F.inline(sides))
