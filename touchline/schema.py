"""Canonical match schema and the fixed feature name lists."""

from __future__ import annotations

from pyspark.sql import types as T

# Raw CSV header name -> canonical column name and type.
# These are the source file's column names and must stay as written.
RAW_COLUMNS = {
    "Date": ("match_date", T.DateType()),
    "HomeTeam": ("home_team", T.StringType()),
    "AwayTeam": ("away_team", T.StringType()),
    "FTR": ("ftr", T.StringType()),
    "HTR": ("htr", T.StringType()),
    "FTHG": ("fthg", T.IntegerType()),
    "FTAG": ("ftag", T.IntegerType()),
    "HTHG": ("hthg", T.IntegerType()),
    "HTAG": ("htag", T.IntegerType()),
    "HS": ("hs", T.IntegerType()),
    "AS": ("as_", T.IntegerType()),
    "HST": ("hst", T.IntegerType()),
    "AST": ("ast", T.IntegerType()),
    "HHW": ("hhw", T.IntegerType()),
    "AHW": ("ahw", T.IntegerType()),
    "HC": ("hc", T.IntegerType()),
    "AC": ("ac", T.IntegerType()),
    "HF": ("hf", T.IntegerType()),
    "AF": ("af", T.IntegerType()),
    "HO": ("ho", T.IntegerType()),
    "AO": ("ao", T.IntegerType()),
    "HY": ("hy", T.IntegerType()),
    "AY": ("ay", T.IntegerType()),
    "HR": ("hr", T.IntegerType()),
    "AR": ("ar", T.IntegerType()),
    "B365H": ("b365h", T.DoubleType()),
    "B365D": ("b365d", T.DoubleType()),
    "B365A": ("b365a", T.DoubleType()),
}

STAT_COLUMNS = ["fthg", "ftag", "hthg", "htag", "hs", "as_", "hst", "ast", "hhw", "ahw",
                "hc", "ac", "hf", "af", "ho", "ao", "hy", "ay", "hr", "ar"]
ODDS_COLUMNS = ["b365h", "b365d", "b365a"]

MATCH_COLUMNS = (["match_id", "match_date", "season_year", "home_team", "away_team", "ftr", "htr"]
                 + STAT_COLUMNS + ODDS_COLUMNS)

OUTCOME_LABELS = {"H": 0, "D": 1, "A": 2}          # fixed values: H/D/A -> 0/1/2
LABEL_TEXT = {0: "Home win", 1: "Draw", 2: "Away win"}  # fixed values: label -> text
OUTCOME_TEXT = {"H": "Home", "D": "Draw", "A": "Away"}  # fixed values: result letter -> text
CLASS_NAMES = ["Home Win", "Draw", "Away Win"]          # fixed values: report row names
SEASON_START_MONTH = 8                                  # fixed value: seasons start in August
LAST_N = 5                                              # fixed value: history window length
MOMENTUM_WEIGHTS = [0.1, 0.15, 0.2, 0.25, 0.3]          # fixed values: oldest -> newest
TOP_K_FEATURES = 80                                     # fixed value: kept features

# The output feature names, in their published order.
H2H_NAMES = [
    "H2H_hometeam_wins", "H2H_awayteam_wins", "H2H_draws",
    "H2H_hometeam_win_pct", "H2H_awayteam_win_pct",
    "H2H_hometeam_halftime_goals", "H2H_awayteam_halftime_goals",
    "H2H_hometeam_fulltime_goals", "H2H_awayteam_fulltime_goals",
    "H2H_goal_diff", "H2H_hometeam_avg_goals", "H2H_awayteam_avg_goals",
    "H2H_hometeam_goals_conceded", "H2H_awayteam_goals_conceded",
    "H2H_hometeam_halftime_wins", "H2H_awayteam_halftime_wins", "H2H_halftime_draws",
    "H2H_hometeam_shots", "H2H_awayteam_shots",
    "H2H_hometeam_shots_on_target", "H2H_awayteam_shots_on_target",
    "H2H_hometeam_shot_accuracy", "H2H_awayteam_shot_accuracy",
    "H2H_hometeam_conversion", "H2H_awayteam_conversion",
    "H2H_hometeam_woodwork", "H2H_awayteam_woodwork",
    "H2H_hometeam_corners", "H2H_awayteam_corners",
    "H2H_hometeam_fouls", "H2H_awayteam_fouls",
    "H2H_hometeam_offsides", "H2H_awayteam_offsides",
    "H2H_hometeam_yellow_card", "H2H_awayteam_yellow_card",
    "H2H_hometeam_red_card", "H2H_awayteam_red_card",
    "H2H_bet365_hometeam_probability_home", "H2H_bet365_hometeam_probability_away",
    "H2H_bet365_awayteam_probability_home", "H2H_bet365_awayteam_probability_away",
    "H2H_bet365_probability_draws",
]

HOME_NAMES = [
    "home_match_wins", "home_win_rate", "home_match_losses", "home_match_draws",
    "home_match_halftime_goals", "home_match_fulltime_goals", "home_match_goals_per_match",
    "home_match_goals_conceded", "home_match_avg_goals_conceded",
    "home_match_clean_sheets",
    "home_match_halftime_wins", "home_match_halftime_losses", "home_match_halftime_draws",
    "home_match_shots", "home_match_shots_on_target", "home_shot_accuracy", "home_conversion_rate",
    "home_match_shots_against", "home_match_shots_on_target_against", "home_match_woodwork_against",
    "home_match_woodwork", "home_match_corners", "home_match_corners_against",
    "home_match_fouls", "home_match_offsides",
    "home_match_yellow_card", "home_match_red_card",
    "home_recent_points", "home_match_momentum",
    "home_match_bet365_probability_wins", "home_match_bet365_probability_losses",
    "home_match_bet365_probability_draws",
]

AWAY_NAMES = [
    "away_match_wins", "away_win_rate", "away_match_losses", "away_match_draws",
    "away_match_halftime_goals", "away_match_fulltime_goals", "away_match_goals_per_match",
    "away_match_goals_conceded", "away_match_avg_goals_conceded",
    "away_match_clean_sheets",
    "away_match_halftime_wins", "away_match_halftime_losses", "away_match_halftime_draws",
    "away_match_shots", "away_match_shots_on_target", "away_shot_accuracy", "away_conversion_rate",
    "away_match_shots_against", "away_match_shots_on_target_against", "away_match_woodwork_against",
    "away_match_woodwork", "away_match_corners", "away_match_corners_against",
    "away_match_fouls", "away_match_offsides",
    "away_match_yellow_card", "away_match_red_card",
    "away_recent_points", "away_match_momentum",
    "away_match_bet365_probability_wins", "away_match_bet365_probability_losses",
    "away_match_bet365_probability_draws",
]

INTERACTION_NAMES = [
    "momentum_difference", "combined_momentum", "form_points_difference",
    "win_rate_difference", "H2H_win_pct_difference",
    "home_attack_vs_away_defense", "away_attack_vs_home_defense",
    "goal_scoring_difference", "goals_conceded_difference",
    "shooting_efficiency_difference", "shots_difference",
    "shots_on_target_difference", "clean_sheet_difference",
    "shot_accuracy_difference", "conversion_rate_difference",
    "home_defensive_pressure", "away_defensive_pressure",
    "shots_on_target_against_difference", "corner_difference",
    "corner_against_difference", "territory_control_difference",
    "fouls_difference", "yellow_card_difference", "red_card_difference",
    "offside_difference", "halftime_goals_difference",
    "halftime_wins_difference", "first_half_strength_difference",
    "bet365_probability_difference", "draw_probability_average",
    "market_confidence", "H2H_form_alignment", "H2H_goals_vs_defense",
    "shot_accuracy_consistency", "discipline_consistency",
    "attacking_threat_differential", "defensive_solidity_differential",
    "balance_score_differential", "form_efficiency_differential",
    "pressure_handling_differential", "finishing_quality_differential",
    "woodwork_differential", "style_clash_indicator",
]

LEAGUE_NAMES = [
    "points", "points_per_game", "goal_difference", "goal_difference_per_game",
    "goals_for_per_game", "goals_against_per_game", "recent_points_per_game",
    "form_trajectory", "win_percentage", "estimated_position_score",
]


def feature_names() -> list[str]:
    """All 159 feature columns in output order."""
    return H2H_NAMES + HOME_NAMES + AWAY_NAMES + INTERACTION_NAMES + LEAGUE_NAMES
