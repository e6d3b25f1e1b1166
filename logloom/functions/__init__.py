"""Column functions: text, network addresses and derived log fields."""
