"""A PySpark engine for queryable text memory: encode, store, search, federate, distil, audit."""

__version__ = "0.1.0"
