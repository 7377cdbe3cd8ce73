"""functions of quernel."""
