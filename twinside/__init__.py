"""Two-sided event analytics on Spark DataFrames.

A *contest* is one event with an A side, a B side, an optional official and
per-side count metrics.  The library turns contests into side rows, season and
form tables, leakage-safe features, count forecasts, a settled prediction
ledger and season-local patterns.  Everything is a lazy DataFrame plan.
"""

__version__ = "0.1.0"
