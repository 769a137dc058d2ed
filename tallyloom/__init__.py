"""Analytical operators for Spark DataFrames."""
