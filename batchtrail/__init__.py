"""batchtrail: batch-process record analytics on Spark.

Typed process tables in, DataFrames out.  See README.md for the layout.
"""

__version__ = "0.1.0"
