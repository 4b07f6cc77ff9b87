"""Readers, writers and fixed values."""
