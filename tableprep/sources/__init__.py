"""Readers, writers and format detection."""
