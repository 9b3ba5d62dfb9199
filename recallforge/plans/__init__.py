"""Registered queries over the test tables, each with DuckDB SQL of the same result where SQL can say it."""
