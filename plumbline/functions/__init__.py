"""Column expressions: tolerances, ratios, status ladders, labels."""
