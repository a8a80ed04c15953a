"""An ordered key-value log on Spark: append-only records, latest-wins views, scans, batches."""
