"""Readers, writers and converters."""
