"""Set-based operators over DataFrames (filters, joins, aggregates, windows, top-k)."""
