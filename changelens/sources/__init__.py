"""Readers of patches, name-status streams, subjects and fixtures."""
