"""Readers: file trees, snapshots, captured URLs, database queries."""
