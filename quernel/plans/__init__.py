"""plans of quernel."""
