from touchline.operators.asof import (  # noqa: F401
    last_n_before_days, last_n_through_days, totals_by_day, asof_before,
)
from touchline.operators.ledger import team_ledger  # noqa: F401
