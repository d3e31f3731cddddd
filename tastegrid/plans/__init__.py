"""Catalog jobs built from the operators."""
