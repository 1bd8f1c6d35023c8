from touchline.functions.columns import (  # noqa: F401
    ratio, inv_mean, pair_lo, pair_hi, season_year, parse_match_date, outcome_label,
    label_text, outcome_text, pct_text, f64, nz,
)
