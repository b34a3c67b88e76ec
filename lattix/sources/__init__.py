"""Lattix sources."""
