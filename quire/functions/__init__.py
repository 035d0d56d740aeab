"""Column-expression scalar functions; no Python UDFs."""
