"""Tick, signal and evaluation operators: functions from DataFrames to DataFrames."""
