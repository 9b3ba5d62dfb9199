"""Operators for preparing large text corpora for language-model training.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames; the modules named after the operators hold the general interfaces
and :mod:`recallforge.llm.queries` binds them to the tables of the query suite.
"""
