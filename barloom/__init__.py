"""Market-series analytics as Spark DataFrame operators.

Every operator takes a long table keyed by ``symbol`` and works on all symbols
in one job.  See README.md for the module map.
"""
