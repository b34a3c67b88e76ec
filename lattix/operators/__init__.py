"""Lattix operators."""
