"""streaming of quernel."""
