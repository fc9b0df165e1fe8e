"""Incremental indexing, upserts and stream joins."""
