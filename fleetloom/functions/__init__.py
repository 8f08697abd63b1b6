"""Column expressions: labels, selectors, quantities, text search and small view columns."""
