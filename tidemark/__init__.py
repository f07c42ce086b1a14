"""Telemetry anomaly analytics on Spark DataFrames."""
