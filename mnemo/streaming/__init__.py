"""Incremental (streaming) feature extraction."""
