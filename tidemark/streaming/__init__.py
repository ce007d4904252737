"""Loads as micro-batches."""
