"""Splicing-outlier analytics and corpus operators on PySpark DataFrames."""
