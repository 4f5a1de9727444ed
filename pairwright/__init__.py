"""Pairwise-judgement evaluation on Spark.

Operators are functions from DataFrame to DataFrame; see README.md for the map.
"""
