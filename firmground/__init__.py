"""Spark-native checks for tables, features and scores: every check is a function from DataFrames to a DataFrame."""
