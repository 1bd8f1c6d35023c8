"""touchline: point-in-time match history features, models and reports on Spark.

Everything is expressed with the DataFrame API so Catalyst/AQE choose the
physical plan.  The package is laid out as

* ``sources``   - season CSV loader, test-table adapter, sinks
* ``functions`` - reusable Column expressions (guarded ratios, odds, dates)
* ``operators`` - the strict as-of last-N operator and season-to-date state
* ``plans``     - feature blocks, summaries, evaluation and model jobs
* ``streaming`` - fixture scoring as a Structured Streaming job
"""

from touchline.session import get_session, checkpoint_dir  # noqa: F401
