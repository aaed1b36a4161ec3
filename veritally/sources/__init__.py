"""Readers, writers and the stores kept next to a run."""
