"""Readers, segmenting and writers."""
