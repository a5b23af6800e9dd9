"""Readers and writers of recordings, annotations, label files, features and selection tables."""
