"""Readers and staged tables."""
