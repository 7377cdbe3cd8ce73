"""generators of quernel."""
