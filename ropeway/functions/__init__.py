"""Column expressions; every function maps Columns to Columns."""
