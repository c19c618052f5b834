"""fitweave: posting, profile and evidence jobs for PySpark.

Every public operator takes DataFrames and returns DataFrames, so jobs compose
with ``DataFrame.transform`` and Catalyst sees one logical plan.
"""
