"""Spark-first analytics for budgeted federated evaluation.

Every public operator is a function from DataFrames to a DataFrame; nothing here
collects data that grows with the input.
"""
