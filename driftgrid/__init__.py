"""Telemetry outlier analysis as Spark DataFrame jobs."""
