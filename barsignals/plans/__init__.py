"""Composite plans: the enriched frame, the driver-table bindings, named queries,
their DuckDB oracle SQL and the SQL view catalog."""
