"""Column expressions: they build plans and never touch data."""
