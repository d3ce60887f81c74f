"""Column functions: profiles (along the 96-value day), stats (aggregates with guards), scalars."""
