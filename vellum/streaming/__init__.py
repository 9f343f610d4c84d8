"""Change feeds, in batch and as streams."""
