"""DuckDB oracle SQL for the driver's correctness check.

The oracle does not reuse the Spark plan: history is selected by brute force
(every earlier row of the key, ranked, top 5) so it checks the as-of
operator independently.
"""
