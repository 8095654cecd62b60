"""Column-level functions: keys, casts, the VOI dictionary (survey §2.2)."""
