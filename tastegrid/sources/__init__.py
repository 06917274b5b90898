"""Readers, writers and persisted fitted state."""
