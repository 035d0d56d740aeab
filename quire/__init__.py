"""quire: announcement filtering, document ingest planning, search and answer
assembly as Spark DataFrame operators.

Subpackages
-----------
sources    readers for the input tables and the derived fixture views; sinks
functions  Column-expression scalar functions (text, hashing, taxonomy)
operators  set-based operators: filters, joins, aggregates, windows, top-k
plans      composed jobs (refresh plan, search report, answer report)
streaming  Structured Streaming twins of the stateful operators
"""

__all__ = ["sources", "functions", "operators", "plans", "streaming"]
