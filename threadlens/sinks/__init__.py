"""Writing results as files."""
