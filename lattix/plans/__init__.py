"""Lattix plans."""
