"""Scalar functions as Columns; Arrow UDFs only where Spark has no function."""
