"""Data-lake jobs as PySpark DataFrame operators."""
