"""Named queries, one family a module; each has a DuckDB twin where SQL can express it."""
