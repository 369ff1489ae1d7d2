"""The same questions as ANSI SQL over the given tables, for side-by-side checks."""
