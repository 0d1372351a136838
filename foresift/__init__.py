"""Forecast postprocessing and verification as Spark DataFrame operators."""
