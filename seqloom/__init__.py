"""Sequence mining, time-series similarity and corpus preparation on Spark DataFrames."""
