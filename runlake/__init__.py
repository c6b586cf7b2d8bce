"""Run-based observation tables on Spark: ingest runs, tabulate them, consolidate them."""
