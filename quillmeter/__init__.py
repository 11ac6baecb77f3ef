"""Usage-telemetry analytics on Spark DataFrames."""
