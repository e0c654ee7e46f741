"""Compositions of operators and the catalogue of checked queries."""
