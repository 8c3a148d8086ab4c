"""teebox: golf scorecard analytics as Spark DataFrame plans.

Layout:
  sources/    table reads and writes, golf-shaped views, JSON export ingest
  functions/  column expressions (classifiers, lenient coalesces, formatting)
  operators/  reusable DataFrame operators (outlier trim, per-18 components,
              count breakdowns, nearest-time matching, keyed upsert)
  plans/      the analytic products built from those operators
  streaming/  incremental ingest with Structured Streaming
"""

__all__ = ["__version__"]
__version__ = "0.1.0"
