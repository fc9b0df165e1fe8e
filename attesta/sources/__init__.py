"""Readers and writers: notes, pages, journals, logs, indexes, snapshots."""
