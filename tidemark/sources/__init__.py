"""Readers, writers and fixture tables."""
