"""Tick-data and signal analytics as Spark DataFrame functions."""
