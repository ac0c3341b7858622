"""Training-data operators: filters, deduplication, joins, archives and packing.

Nothing else in the library imports this subpackage. Every operator takes and
returns DataFrames; tables that an operator writes between its steps go below
``spark.checkpoint.dir`` (see :mod:`weftgraph.llm.common`).
"""
