"""Stateful reassembly of token streams."""
