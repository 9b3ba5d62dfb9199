"""Scalar functions as Column builders, with Arrow UDFs where no expression exists."""
