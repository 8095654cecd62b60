"""Relational and series operators (survey §2.3-§2.10)."""
