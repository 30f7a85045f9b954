"""Column functions (Column -> Column)."""
