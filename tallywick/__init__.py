"""Spark-native case and market analytics.

``sources`` read and write tables and documents, ``functions`` are column expressions, ``operators`` turn
DataFrames into DataFrames, and ``plans`` string operators together into the four end-to-end runs
(county map, state report, price averages, market table).
"""
