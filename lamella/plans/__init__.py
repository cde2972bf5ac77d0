"""Query plans: what to compute, as plain data."""
