"""Versioned documents on Spark: queries, time travel, merging and change feeds as DataFrame plans."""
