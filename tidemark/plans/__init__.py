"""Whole runs: read a source, find what changed, bring the index up to date."""
