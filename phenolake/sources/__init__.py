"""Readers, writers and the bindings of the sample tables."""
