"""Import every module that registers queries."""

from seqloom.plans import exports, files, sequences, texts, vectors  # noqa: F401
