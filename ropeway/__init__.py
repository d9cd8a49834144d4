"""Telecom KPI, monitoring and evaluation analytics on Spark DataFrames."""
