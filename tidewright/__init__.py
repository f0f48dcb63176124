"""tidewright: completeness-aware stream analytics on PySpark.

Core packages: ``operators`` (DataFrame operators), ``sources`` (formats, commit log, journals), ``functions`` (column
expressions), ``plans`` (query engine and query registry), ``streaming`` (landing and K-slack streams).

Columns whose names begin with ``__tw_`` are the operators' own; every other name is free for the caller's tables.
"""
