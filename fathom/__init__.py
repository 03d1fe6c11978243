"""fathom: catalogue, browse, preview, series and run-manifest jobs on Spark.

Every operator takes DataFrames and returns DataFrames built from Spark SQL
built-in functions, so Catalyst plans them and the same code runs on a laptop
sample or a cluster.
"""

__version__ = "0.1.0"
