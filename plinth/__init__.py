"""Structural questions about source repositories, answered with Spark DataFrames."""
