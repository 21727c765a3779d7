"""Readers, writers and the domain views over the supplied tables."""
