"""Column expressions: no plan nodes, no Python UDFs."""
