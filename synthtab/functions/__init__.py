"""Column-level building blocks: no jobs, only expressions."""
