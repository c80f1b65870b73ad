"""Scalar expressions shared by the operators: all built from Spark's own functions."""
