"""quernel: Spark jobs for building and auditing training data."""
