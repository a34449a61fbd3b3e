"""Spark-first analytics for performance telemetry."""
