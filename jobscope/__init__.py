"""Batch-job telemetry and batch-workflow analytics on Spark DataFrames."""

__version__ = "0.1.0"
