"""Imaging-metadata analytics and corpus operators on PySpark DataFrames."""
