"""Readers, writers and adapters from the supplied tables."""
