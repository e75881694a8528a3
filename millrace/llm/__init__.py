"""Operators for large-scale training-data pipelines.

Ten operators over tables of texts and pages, each in a module of its own,
with the registered queries in :mod:`millrace.llm.queries`.  Nothing outside
this subpackage imports it.
"""
