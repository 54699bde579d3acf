"""plaudit: review analytics expressed as Spark DataFrame plans.

Layout
------
functions/  Column -> Column expressions (per-review, JVM-side, codegen friendly)
sources/    readers, writers and the ingest path (CSV, API pages, dedupe, sinks)
operators/  DataFrame -> DataFrame operators (scans, stats, time series, text,
            sentiment, quality, versions, recommendation, benchmarking, alerts)
plans/      bundles of operators plus the registered query catalogue and the
            SQL oracle used to check it
streaming/  Structured Streaming jobs that reuse the batch operators
"""

__version__ = "0.1.0"
