"""Operators for large-scale training-data pipelines.

Every operator lives in a module of its own and takes and returns Spark
DataFrames.  Nothing else in the library imports this subpackage.
"""
