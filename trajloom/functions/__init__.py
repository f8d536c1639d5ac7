"""Pure Column expressions: no jobs, no schema changes."""
