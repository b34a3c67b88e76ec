"""Lattix streaming."""
