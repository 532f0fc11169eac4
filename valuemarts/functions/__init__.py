"""Column helpers: exact rounding, date arithmetic, display labels."""
