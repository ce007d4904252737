"""Normalising raw records to typed facts, and reconciling loads with what is stored."""
