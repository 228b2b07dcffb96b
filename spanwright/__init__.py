"""spanwright: agent-trace evaluation and trace-table processing on Spark.

Everything is a function from DataFrames to DataFrames; see README.md for the map of modules.
"""

__version__ = "0.1.0"
