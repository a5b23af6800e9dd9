"""Sequence, window, join, distance and index operators."""
