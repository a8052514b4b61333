"""Millrace: quality control and training-data operators as PySpark plans."""
