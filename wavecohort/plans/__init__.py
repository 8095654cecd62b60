"""Plans: bindings of the operators' input roles to concrete tables, and the
registered queries (name → Spark plan, name → DuckDB oracle SQL)."""
