"""Unicode text analytics for PySpark DataFrames."""
