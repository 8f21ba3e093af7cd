"""Operators of a training-data pipeline: joins, mixing, packing, sharding, cleaning.

Nothing outside this folder imports it.  Every operator takes DataFrames and returns
DataFrames; ``queries.py`` applies them to the sample tables.
"""
