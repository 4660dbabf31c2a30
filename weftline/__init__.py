"""Spark-first analytics over change sets: every operator maps DataFrames to DataFrames."""
