"""sources of quernel."""
