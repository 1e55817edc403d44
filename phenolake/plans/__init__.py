"""Registered queries and the composed batch plans."""
