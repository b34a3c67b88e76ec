"""Lattix functions."""
