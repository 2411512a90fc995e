"""tidewatch: event-stream analytics and data preparation on PySpark.

Every operator is a function from DataFrames to DataFrames.  Nothing is
collected to the driver unless its size is bounded by a documented parameter.
"""

__version__ = "0.1.0"
