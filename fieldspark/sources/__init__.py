"""Readers, writers, imports and the domain views over the given tables."""
