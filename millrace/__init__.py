"""A pipeline and query library on PySpark DataFrames."""
