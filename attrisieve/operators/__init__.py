"""The engine's operators: functions from DataFrames to DataFrames."""
