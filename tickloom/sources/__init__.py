"""Readers, normalisers and partitioned writers."""
