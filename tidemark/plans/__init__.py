"""Analytical queries over the operators."""
