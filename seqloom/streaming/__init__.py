"""Streams of files that become tokens, sequences and indexes."""
