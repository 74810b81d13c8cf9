"""Independent SQL oracles (DuckDB dialect) for the registered queries."""
