"""XML analytics on Spark: documents in, one row per parse event out, everything else a DataFrame."""
