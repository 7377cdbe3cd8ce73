"""operators of quernel."""
